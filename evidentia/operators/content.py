"""Main content of pages: blocks scored by text, links and place, with a chain of fallbacks.

The parser only outlines a page: its blocks of text with their length, the part of it in links, and the two
boxes (containers) around each, numbered so that a box holds the boxes from its own number to its last one.
What is content is then decided by aggregates over the blocks, dealt out by page once:

* scored: each block gives its points to its box and half of them to the one above; the best box stays with
  those of its siblings that are nearly as good; what names itself advertising or navigation is left out.
* dense: blocks of few links that are long, or stand beside a long one, whatever their boxes are called.
* paragraphs: paragraphs, headings and items of more than 40 characters of the article, else of the page; all
  text of the page if they are short.
* none: no method finds enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_spaces, token_count
from .html import BLOCK_LEAST, SKIPPED, VOID

BOXES = frozenset(("body", "div", "section", "article", "main", "td", "ul", "ol", "dl", "table", "blockquote", "figure", "details"))
BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "tr", "th", "caption", "hr", "br", "form", *BOXES))
PARAGRAPHS = ("p", "h1", "h2", "h3", "li")
#: Words in classes and ids of boxes that seldom and that mostly hold content.
AGAINST = re.compile(r"(?i)(?<![a-z])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|menu|nav\w*|newsletter|popup|promo\w*|related|share|sidebar|social|sponsor\w*|subscribe|widget)(?![a-z])")
FAVOUR = re.compile(r"(?i)(?<![a-z])(article|body|content|entry|main|post|story|text)(?![a-z])")
#: Characters from which a text is enough, a block gives points, and a block is long; most of a block's text in links; share of the best score that keeps a sibling.
ENOUGH, SCORED_FROM, LONG, LINKED_MOST, NEARLY = 200, 25, 80, 0.5, 0.2

_BLOCK = "array<struct<pos: int, tag: string, text: string, chars: int, linked: int, box: int, box_end: int, hint: int, up: int, up_end: int, up_hint: int, over: int, out: boolean, main: boolean>>"


class Outline(HTMLParser):
    """Blocks of a page with their boxes, its title and the date it states."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.date, self.blocks = "", "", []
        self._boxes = [[0, 0, 0, -1, False, False]]  # number, last number, hint, the box above, named out, in the article
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._junk, self._title, self._links, self._text, self._linked, self._tag = 0, False, 0, [], 0, ""

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag == "meta" and (at.get("property") or at.get("name") or "").lower() in ("article:published_time", "date", "datepublished", "pubdate"):
            self.date = self.date or (at.get("content") or "")
        elif tag == "time" and not self.date:
            self.date = at.get("datetime") or ""
        if tag in BLOCKS:
            self._flush(tag)
        self._title |= tag == "title"
        self._links += tag == "a"
        self._junk += tag in SKIPPED
        if tag in VOID:
            return
        box = self._stack[-1][1]
        if tag in BOXES:
            own, above = f"{at.get('class') or ''} {at.get('id') or ''}", self._boxes[box]
            hint = (1 if FAVOUR.search(own) or tag in ("article", "main") else 0) - (1 if AGAINST.search(own) else 0)
            self._boxes.append([len(self._boxes), len(self._boxes), hint, box, above[4] or (hint < 0 and tag != "body"), above[5] or tag in ("article", "main")])
            box = len(self._boxes) - 1
        self._stack.append((tag, box))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush("")
        if tag == "title":
            self._title = False
        if any(t == tag for t, _ in self._stack):
            while True:
                t, box = self._stack.pop()
                self._junk -= t in SKIPPED
                self._links -= t == "a"
                if t in BOXES:
                    self._boxes[box][1] = len(self._boxes) - 1
                if t == tag:
                    break
        if tag in BLOCKS:
            self._tag = self._stack[-1][0]

    def handle_data(self, data):
        if self._title:
            self.title += data
        elif not self._junk:
            self._text.append(data)
            self._linked += len("".join(data.split())) if self._links else 0

    def _flush(self, tag: str) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            own = self._tag if self._tag in BLOCKS else "div"
            self.blocks.append((own, text, self._linked, self._stack[-1][1]))
        self._text, self._linked, self._tag = [], 0, tag or self._tag

    def outline(self) -> list[tuple]:
        self._flush("")
        for _, box in self._stack:
            self._boxes[box][1] = len(self._boxes) - 1
        out = []
        for pos, (tag, text, linked, box) in enumerate(self.blocks):
            number, end, hint, above, named_out, main = self._boxes[box]
            up = self._boxes[above] if above >= 0 else [-1, -1, 0, -1, False, False]
            out.append((pos, tag, text, len("".join(text.split())), linked, number, end, hint, up[0], up[1], up[2], up[3], named_out, main))
        return out


def outlines(pages: DataFrame, *, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """(key, title, published_date, blocks) of each page; null html has no blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for k, html in zip(pdf[key], pdf[html_col], strict=True):
                page = Outline()
                page.feed(html or "")
                page.close()
                made.append((k, " ".join(page.title.split()), page.date, page.outline()))
            yield pd.DataFrame(made, columns=[key, "title", "published_date", "blocks"])

    return pages.select(key, html_col).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, title string, published_date string, blocks {_BLOCK}")


def _joined(when: Column) -> Column:
    """The texts for which when holds, a line each, in order."""
    rows = F.array_sort(F.collect_list(F.when(when, F.struct("pos", "text"))))
    return normalise_spaces(F.array_join(F.transform(rows, lambda x: x["text"]), "\n"))


def main_content(pages: DataFrame, *, key: str = "page_id", html_col: str = "html", enough: int = ENOUGH) -> DataFrame:
    """(key, title, text, published_date, extraction_method, word_count) of every page; text is empty where the method is none.

    A method counts if it finds ``enough`` characters. Null and empty pages have none. Keys should be unique: rows
    of one key are one page.
    """
    parsed = outlines(pages, key=key, html_col=html_col)
    rows = parsed.select(F.col(key).alias("k"), F.explode("blocks").alias("b")).select("k", "b.*").repartition(F.col("k"))
    few = F.col("linked") < LINKED_MOST * F.col("chars")
    commas = F.regexp_count("text", F.lit("[,،、，]"))
    points = F.when(~F.col("out") & few & (F.col("chars") >= SCORED_FROM), 1 + commas + F.least(F.col("chars") / 100, F.lit(3.0))).otherwise(0.0)
    rows = rows.withColumn("points", points)

    # Boxes: their own blocks' points, and half of those of the boxes in them.
    gives = lambda node, end, hint, up, share: F.struct(F.col(node).alias("node"), F.col(end).alias("end"), F.col(hint).alias("hint"), F.col(up).alias("up"), (F.col("points") * share).alias("points"))
    given = rows.select("k", "chars", "linked", F.inline(F.array(gives("box", "box_end", "hint", "up", 1.0), gives("up", "up_end", "up_hint", "over", 0.5)))).where("node >= 0")
    boxes = given.groupBy("k", "node").agg(F.first("end").alias("end"), F.first("hint").alias("hint"), F.first("up").alias("up"), F.sum("points").alias("points"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    # Where nothing has points, a friendly name alone makes no content.
    scored = boxes.where("points > 0").withColumn("score", (F.col("points") + 5 * F.col("hint")) * (1 - F.col("linked") / F.col("chars")))
    best = scored.groupBy("k").agg(F.max_by(F.struct("node", "up", "score"), F.struct("score", (-F.col("node")).alias("n"))).alias("best"))
    near = scored.join(best, "k").where((F.col("node") == F.col("best.node")) | ((F.col("up") == F.col("best.up")) & (F.col("score") >= F.greatest(F.lit(10.0), NEARLY * F.col("best.score")))))
    chosen = near.groupBy("k").agg(F.collect_list(F.struct("node", "end")).alias("chosen"))

    order = Window.partitionBy("k").orderBy("pos")
    long = few & (F.col("chars") >= LONG)
    told = rows.withColumn("long", long).withColumn("beside", F.coalesce(F.lag("long").over(order), F.lit(False)) | F.coalesce(F.lead("long").over(order), F.lit(False)))
    told = told.withColumn("any_main", F.max("main").over(Window.partitionBy("k"))).join(chosen, "k", "left")
    inside = F.coalesce(F.exists("chosen", lambda c: (F.col("box") >= c["node"]) & (F.col("box") <= c["end"])), F.lit(False))
    paragraph = F.col("tag").isin(*PARAGRAPHS) & (F.length("text") > BLOCK_LEAST) & (F.col("main") | ~F.col("any_main"))
    texts = told.groupBy("k").agg(
        _joined(inside & few & ~F.col("out")).alias("scored"),
        _joined(few & (F.col("long") | F.col("beside"))).alias("dense"),
        _joined(paragraph).alias("paragraphs"),
        _joined(F.lit(True)).alias("all"),
    )
    plain = F.when(F.length("paragraphs") >= ENOUGH, F.col("paragraphs")).otherwise(F.col("all"))
    texts = texts.select("k", "scored", "dense", plain.alias("paragraphs"))
    methods = ("scored", "dense", "paragraphs")
    which = F.coalesce(*[F.when(F.length(m) >= enough, F.lit(m)) for m in methods], F.lit("none"))
    texts = texts.select("k", which.alias("extraction_method"), F.coalesce(*[F.when(F.length(m) >= enough, F.col(m)) for m in methods], F.lit("")).alias("text"))
    made = parsed.select(F.col(key).alias("k"), "title", "published_date").join(texts, "k", "left").fillna({"extraction_method": "none", "text": ""})
    return made.select(F.col("k").alias(key), "title", "text", "published_date", "extraction_method", token_count(F.col("text")).alias("word_count"))
