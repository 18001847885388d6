"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Benchmark items are cut into windows of ten consecutive words; an item of fewer words (but not none)
is one window. Windows of one length form a pattern set. Its symbols are word hashes and its blocks are
pairs of words (single words for one-word windows): a shift table says how far a cursor may jump past
the block it stands on; where a block ends a window, the bucket of that suffix and of the window's hash
selects the test strings, and their words are compared directly before an occurrence counts. Cursors of
a whole slice of documents advance together.

The benchmark is a stated query set. It is cut into blocks of at most ``block_bytes`` of text. The
driver builds the tables of a block, flat arrays of about nine bytes for each byte of text, and
broadcasts them; a worker loads one block after the other and runs a batch of documents against it, so
that neither holds more than one block's tables, whatever the size of the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import bounded
from .textscan import ALNUM, Words, mix, slices

WINDOW = 10
#: Cursors start every so many words, so that long documents are searched by many cursors at once.
SPAN = 256
#: Benchmark text whose tables are held at once.
BLOCK_BYTES = 8_000_000

_ROLL = np.uint64(0xD6E8FEB86659FD93)


class PatternSet:
    """Wu-Manber tables for windows of one length, as flat arrays.

    keys and shift: blocks of words and how far a cursor on one may jump. bucket, at, first, items: the windows in the
    order of a hash of suffix block and window, the word at which each stands, and the items that have it.
    """

    def __init__(self, length: int, words: Words, counts: np.ndarray, chosen: np.ndarray):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.data, self.start, self.end = words.data, words.start.astype(np.int32), words.end.astype(np.int32)
        begin = words.first[chosen]
        many = counts[chosen] - self.block + 1  # blocks of each item
        item = np.repeat(np.arange(len(chosen)), many)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + self.block - 1  # the word that ends the block
        last = begin[item] + nth
        key = self.block_keys(words.hash, last)
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        self.keys = key[order][cut]
        self.shift = np.minimum.reduceat(np.maximum(0, length - 1 - nth)[order], cut).astype(np.int16)
        ends = nth >= length - 1
        self._fill(self.bucket_keys(words.hash, last[ends], key[ends]), last[ends] - length + 1, chosen[item[ends]])

    def _fill(self, key: np.ndarray, at: np.ndarray, item: np.ndarray) -> None:
        """Windows of equal words become one entry with all their items; windows that share a hash only stay apart."""
        order = np.lexsort((item, key))
        key, at, item = key[order], at[order], item[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        group = np.repeat(np.arange(len(cut)), size)
        own = np.zeros(len(key), dtype=np.int64)  # number of a window among those of its hash
        for s, n in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            seen: dict[bytes, int] = {}
            for i in range(s, s + n):
                own[i] = seen.setdefault(self.window(int(at[i])), len(seen))
        order = np.lexsort((item, own, group))
        group, own, at, item = group[order], own[order], at[order], item[order]
        fresh = np.append(True, (group[1:] != group[:-1]) | (own[1:] != own[:-1]))
        once = fresh | np.append(True, item[1:] != item[:-1])
        entry = np.flatnonzero(fresh)
        self.bucket, self.at = key[entry], at[entry].astype(np.int32)
        self.items = item[once].astype(np.int32)
        self.first = np.append(np.flatnonzero(fresh[once]), len(self.items)).astype(np.int32)

    def window(self, at: int) -> bytes:
        """The words of the benchmark from word at on, joined by single spaces."""
        return b" ".join(self.data[self.start[j] : self.end[j]].tobytes() for j in range(at, at + self.length))

    def block_keys(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix(h[last - 1] * _ROLL + h[last]) if self.block == 2 else h[last]

    def bucket_keys(self, h: np.ndarray, last: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Hashes of the suffix block and all words of the windows that end at last."""
        out = suffix.copy()
        for j in range(self.length - 1, -1, -1):
            out = out * _ROLL + h[last - j]
        return mix(out)

    def search(self, words: Words) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, numbers of the items) of every confirmed occurrence."""
        counts, back = words.counts(), self.length - 1
        spans = np.maximum(0, -(-(counts - back) // SPAN))  # window ends are dealt out to cursors, SPAN each
        doc = np.repeat(np.arange(len(counts)), spans)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)
        at = words.first[doc] + back + nth * SPAN
        stop = np.minimum(at + SPAN, words.first[doc + 1])
        h = words.hash
        while len(at):
            keys = self.block_keys(h, at)
            slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            jump = np.where(self.keys[slot] == keys, self.shift[slot], self.default)
            ends = at[jump == 0]
            bucket = self.bucket_keys(h, ends, keys[jump == 0])
            lo, hi = np.searchsorted(self.bucket, bucket), np.searchsorted(self.bucket, bucket, side="right")
            for i in np.flatnonzero(hi > lo).tolist():
                p = int(ends[i]) - back
                text = words.window(p, self.length)
                for e in range(int(lo[i]), int(hi[i])):
                    if self.window(int(self.at[e])) == text:
                        yield p, self.items[self.first[e] : self.first[e + 1]]
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]


def pattern_sets(texts: list[str], window: int = WINDOW) -> list[PatternSet]:
    """The tables of the items' windows, one set for each length that occurs."""
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw]), ALNUM)
    counts = words.counts()
    size = np.minimum(counts, window)
    return [PatternSet(n, words, counts, np.flatnonzero(size == n)) for n in np.unique(size).tolist() if n]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> list:
    """Broadcasts of (item ids, tables), each of the items of at most about block_bytes of text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) if total else 0
    out = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        rows = list(part.toLocalIterator())
        out.append(spark.sparkContext.broadcast(([r.i for r in rows], pattern_sets([r.t for r in rows], window))))
    return out


def _scan(batches: Iterator[pa.RecordBatch], text_at: int, sent: list) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict, dict]]:
    """Each batch with its word counts, and the word spans and item ids found, by row."""
    for batch in batches:
        n_words = np.zeros(batch.num_rows, dtype=np.int64)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        for one in sent or [None]:
            names, tables = one.value if one is not None else ([], [])
            for first, last, data, offsets in slices(batch.column(text_at)):
                words = Words(data, offsets, ALNUM)
                n_words[first:last] = words.counts()
                for patterns in tables:
                    for at, own in patterns.search(words):
                        d = int(np.searchsorted(words.first, at, side="right")) - 1
                        start = at - int(words.first[d])
                        found[first + d].append((start, start + patterns.length))
                        items[first + d].update(names[i] for i in own.tolist())
            if len(sent) > 1:
                vars(one).pop("_value", None)  # the worker's copy; the arrays are loaded again for the next batch
        yield batch, n_words, found, items


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, hits (word spans [start, end), merged), items (ids).

    Null and empty texts have no words and no hits, and an empty table gives an empty one. Repeated rows give repeated results. Null item ids
    and null or wordless items match nothing; equal windows of several items count for each of them.
    Item ids are compared and sorted as strings. Other columns of either table are ignored.
    """
    sent = _blocks(benchmark, item_col, item_text_col, block_bytes, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n_words, found, items in _scan(batches, 1, sent):
            n = batch.num_rows
            spans = [_merged(found[i]) if i in found else [] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words),
                    pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(items[i]) if i in items else [] for i in range(n)], pa.list_(pa.string())),
                ],
                names=[id_col, "n_words", "n_hit", "hits", "items"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, n_hit bigint, hits array<struct<start: bigint, end: bigint>>, items array<string>"
    return bounded(docs).select(id_col, F.col(text_col).cast("string")).mapInArrow(scan, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from decontaminate()'s rows."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.0, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows of which more than max_share of the words lie in benchmark windows; columns as in docs, no shuffle."""
    sent, at = _blocks(benchmark, item_col, item_text_col, block_bytes, window), docs.columns.index(text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n_words, found, _ in _scan(batches, at, sent):
            hit = np.zeros(batch.num_rows)
            for i, spans in found.items():
                hit[i] = sum(e - s for s, e in _merged(spans))
            yield batch.filter(pa.array(hit <= max_share * n_words))

    return bounded(docs).mapInArrow(sift, docs.schema)


__all__ = ["PatternSet", "decontaminate", "digest", "drop_contaminated", "pattern_sets"]
