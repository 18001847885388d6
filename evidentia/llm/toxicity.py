"""Toxicity by a weighted finite-state pattern grammar.

A cascade of weighted transducers reads a clause. The lexical one has a single state and rewrites words
as symbols: insult, threat, target, negation, reporting verb, other; an insult has a weight. Its insults
are a short fixed list and what labelled texts teach: words, and word beginnings whose derived words mark
toxic texts (inflected and compounded insults share their beginnings), far beyond chance. Then come

    target     insults and threats with a target up to AIM words before or after them are aimed; an insult
               without one keeps a part of its weight, a threat without one is none. What follows a word is
               not known when it is read, so there are two paths, and one dies if no target comes.
    negation   what follows a negation within REACH words is negated and keeps a part of its weight
    report     what follows a reporting verb in its clause is reported and keeps a part of its weight

These three are composed into one machine by the product of their states, in which weights multiply. A
clause's matches are the outputs of the best path through it: that of the greatest sum of word weight
times arc weight. A text's score is a logistic function of its matches' weights by kind. The lexicon and
the logistic layer are fitted on at most ``SAMPLE`` toxic and ``SAMPLE_CLEAN`` other texts, a
deterministic sample by hash of at most ``SAMPLE_BYTES`` bytes; texts are read as a whole, in fitting as
in scoring. The logistic layer sees each half of the sample through the lexicon of the other half, as it
will see texts that taught the lexicon nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import bounded
from .textscan import Words, mix, prefix_hashes, range_hashes, slices

#: Bounds of the training sample: toxic texts, other texts, and bytes in all.
SAMPLE, SAMPLE_CLEAN, SAMPLE_BYTES = 1_500, 3_000, 100_000_000
#: Lengths in bytes of the word beginnings that are learned.
STEMS = (4, 5, 6, 7)
#: Least log-odds of a learned entry, texts that it is in at least, and what its log-likelihood ratio needs beyond chance among all candidates (Bonferroni).
LEAST_ODDS, LEAST_TEXTS, MARGIN = 1.8, 3, 2.0
#: Words that a target and a negation reach.
AIM, REACH = 6, 3
#: What an insult without a target, a negated and a reported match keep of their weight.
PLAIN, NEGATED, REPORTED = 0.3, 0.2, 0.2
#: Texts whose word sketches of so many hashes agree in this share are near copies.
SKETCH, ALIKE = 32, 0.8

#: The base lexicon.
INSULTS = "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash clown disgusting imbecile fool fools jerk garbage vermin filth idiota imbécil estúpido basura idiote imbécile ordure débile dummkopf abschaum trottel".split()
THREATS = "kill destroy hurt beat punish shoot stab crush töten zerstören tuer détruire matar destruir".split()
TARGETS = "you your yours they them he she him her these those people du ihr euch tu vous toi ils usted ustedes ellos".split()
NEGATIONS = "not never no nobody isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says wrote quoted claimed reported called allegedly sagte schrieb behauptete dit écrit affirmé dijo escribió afirmó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED, DENIED = range(8)
KINDS = ("plain", "aimed", "negated", "reported", "threat")
#: Output of the whole cascade: no match, and 1 + the kind's number.
NONE = 0

#: Bytes of words (letters, non-ASCII and the apostrophe) and bytes that end a clause.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = LETTERS[0x27] = True
CLAUSE_END = np.zeros(256, dtype=bool)
CLAUSE_END[[ord(c) for c in ".,;:!?\n|()\""]] = True


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Transducer:
    """States and arcs: arcs[state][symbol] is a list of (next state, output, weight); paths end in accepting states."""

    start: object
    arcs: dict = field(default_factory=dict)
    accepting: set = field(default_factory=set)

    def arc(self, state: object, symbol: int, then: object, output: int, weight: float = 1.0) -> None:
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append((then, output, weight))
        self.arcs.setdefault(then, {})

    def compose(self, other: Transducer) -> Transducer:
        """The transducer that gives its output to the other: states are pairs, weights multiply."""
        out = Transducer((self.start, other.start))
        open_, seen = [out.start], {out.start}
        while open_:
            p, q = state = open_.pop()
            if p in self.accepting and q in other.accepting:
                out.accepting.add(state)
            for symbol, arcs in self.arcs[p].items():
                for p2, middle, w in arcs:
                    for q2, output, v in other.arcs[q].get(middle, ()):
                        out.arc(state, symbol, (p2, q2), output, w * v)
                        if (p2, q2) not in seen:
                            seen.add((p2, q2))
                            open_.append((p2, q2))
        return out

    def best(self, symbols: list[int], weights: list[float], start: object = None) -> list[tuple[int, float]]:
        """(output, weight) of each symbol on the path of the greatest sum of symbol weight times arc weight; ties to the first arc."""
        paths = {self.start if start is None else start: (0.0, None)}
        for symbol, weight in zip(symbols, weights, strict=True):
            after: dict = {}
            for state, (total, path) in paths.items():
                for then, output, w in self.arcs[state].get(symbol, ()):
                    if then not in after or total + weight * w > after[then][0]:
                        after[then] = total + weight * w, (path, output, weight * w)
            paths = after
        path = max((x for state, x in paths.items() if state in self.accepting), key=lambda x: x[0], default=(0.0, None))[1]
        out = []
        while path:
            path, output, w = path
            out.append((output, w))
        return out[::-1]


def target_transducer() -> Transducer:
    """States: 0, ("seen", words since the target), ("due", words since the first match that waits for its target)."""
    t = Transducer(0)
    states = [0, *(("seen", n) for n in range(1, AIM + 1)), *(("due", n) for n in range(1, AIM + 1))]
    t.accepting = {s for s in states if not (s and s[0] == "due")}
    for state in states:
        name, n = state or ("none", 0)
        later = 0 if not state or (name, n) == ("seen", AIM) else (name, n + 1)
        if (name, n) == ("due", AIM):
            t.arc(state, TARGET, ("seen", 1), TARGET)  # the last chance
            continue
        for symbol in (OTHER, NEGATION, REPORT):
            t.arc(state, symbol, later, symbol)
        t.arc(state, TARGET, ("seen", 1), TARGET)
        if state:
            t.arc(state, INSULT, later, AIMED)
            t.arc(state, THREAT, later, THREAT)
        else:
            t.arc(state, INSULT, 0, INSULT, PLAIN)
            t.arc(state, INSULT, ("due", 1), AIMED)
            t.arc(state, THREAT, 0, OTHER, 0.0)
            t.arc(state, THREAT, ("due", 1), THREAT)
    return t


def negation_transducer() -> Transducer:
    """States: how many more words the negation reaches."""
    t = Transducer(0, accepting=set(range(REACH + 1)))
    for left in range(REACH + 1):
        then = max(0, left - 1)
        t.arc(left, NEGATION, REACH, OTHER)
        for symbol in (OTHER, TARGET):
            t.arc(left, symbol, then, OTHER)
        t.arc(left, REPORT, then, REPORT)
        for symbol in (INSULT, AIMED, THREAT):
            t.arc(left, symbol, then, DENIED if left else symbol, NEGATED if left else 1.0)
    return t


def report_transducer() -> Transducer:
    """States: whether a reporting verb came before. Its outputs are the kinds of matches."""
    kind = {name: 1 + i for i, name in enumerate(KINDS)}
    t = Transducer(0, accepting={0, 1})
    for said in (0, 1):
        t.arc(said, OTHER, said, NONE)
        t.arc(said, REPORT, 1, NONE)
        for symbol, name in ((INSULT, "plain"), (AIMED, "aimed"), (THREAT, "threat"), (DENIED, "negated")):
            t.arc(said, symbol, said, kind["reported" if said else name], REPORTED if said else 1.0)
    return t


#: The composed grammar, and its start after a reporting verb.
MACHINE = target_transducer().compose(negation_transducer()).compose(report_transducer())
AFTER_REPORT = ((0, 0), 1)


@dataclass
class Grammar:
    """Insult weights by hash of the word or beginning, and the logistic layer."""

    keys: np.ndarray
    odds: np.ndarray
    coef: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.2, 0.2, 0.2, 1.0, 0.5]))
    bias: float = -3.0


def _hash_of(word: str, n: int = 0) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    c = prefix_hashes(raw)
    return int(mix(range_hashes(c, np.array([0]), np.array([n or len(raw)])) + np.uint64(n))[0])


_CLASSES = {c: np.array(sorted(_hash_of(w) for w in words), dtype=np.uint64) for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))}


def _entries(words: Words) -> np.ndarray:
    """[words, 1 + stems] hashes of each word and of its beginnings; 0 where a word is no longer than the beginning."""
    c = prefix_hashes(words.data)
    s, e = words.start, words.end
    cols = [mix(range_hashes(c, s, e))]
    for n in STEMS:
        cols.append(np.where(e - s > n, mix(range_hashes(c, s, np.minimum(s + n, e)) + np.uint64(n)), np.uint64(0)))
    return np.stack(cols, axis=1)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(values.shape, -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def matches(grammar: Grammar, words: Words) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, float]]]:
    """[documents, kinds] match weights with repetition damped, the same summed in full, and all matches: (first word of the clause, word, kind, weight).

    Every match counts. n matches of one word in one kind weigh log2(1 + n) times as much as one: repetition says less each time.
    """
    docs = len(words.first) - 1
    sums, full = np.zeros((docs, len(KINDS))), np.zeros((docs, len(KINDS)))
    out: list[tuple[int, int, int, float]] = []
    if not len(words.start):
        return sums, full, out
    entries = _entries(words)
    at = _member(entries, grammar.keys)
    weight = np.where(at >= 0, grammar.odds[at] if len(grammar.odds) else 0.0, 0.0).max(axis=1)
    symbol = np.zeros(len(words.start), dtype=np.int8)
    for c, table in _CLASSES.items():
        symbol[_member(entries[:, 0], table) >= 0] = c
    symbol[weight > 0] = INSULT
    ends = np.cumsum(CLAUSE_END[words.data])
    doc = np.repeat(np.arange(docs), words.counts())
    cut = np.ones(len(doc), dtype=bool)
    cut[1:] = (np.diff(ends[words.start]) != 0) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(doc))
    said = np.concatenate([[0], np.cumsum(symbol == REPORT)])
    hot = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(hot):
        return sums, full, out
    clause = np.searchsorted(begin, hot, side="right") - 1
    # Words further than AIM from any insult or threat change nothing but whether something is reported, so a clause is read in parts.
    new = np.append(True, (clause[1:] != clause[:-1]) | (np.diff(hot) > 2 * AIM))
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hot)) - 1
    lo, hi = np.maximum(begin[clause[first]], hot[first] - AIM), np.minimum(stop[clause[first]], hot[last] + AIM + 1)
    seen: dict[tuple[int, int, int], int] = {}
    for c, s, e in zip(clause[first].tolist(), lo.tolist(), hi.tolist(), strict=True):
        b = int(begin[c])
        for word, kind, w in clause_matches(symbol[s:e].tolist(), weight[s:e].tolist(), bool(said[s] > said[b])):
            name = (int(doc[s]), int(entries[s + word, 0]), kind)
            n = seen[name] = seen.get(name, 0) + 1
            sums[doc[s], kind] += w * float(np.log2((1 + n) / n))
            full[doc[s], kind] += w
            out.append((b, s + word, kind, w))
    return sums, full, out


def clause_matches(symbols: list[int], weights: list[float], reported: bool = False) -> Iterator[tuple[int, int, float]]:
    """The matches of one clause, or of a part after a reporting verb: (word, kind, weight). A threat weighs 1."""
    own = [1.0 if s == THREAT else w for s, w in zip(symbols, weights, strict=True)]
    for i, (output, w) in enumerate(MACHINE.best(symbols, own, AFTER_REPORT if reported else None)):
        if output != NONE:
            yield i, output - 1, w


def _features(sums: np.ndarray, full: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    dense = full[:, [0, 1, 4]].sum(axis=1) / np.maximum(20.0, n_words) * 100
    return np.column_stack([np.log1p(sums), np.log1p(dense)])


def _ratio(one: np.ndarray, zero: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratios of counts in toxic and other texts against equal rates."""
    both, n = one + zero, n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.nan_to_num(one * np.log(one * n / (both * n1))) + np.nan_to_num(zero * np.log(zero * n / (both * n0))))


def first_of_near_copies(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Numbers of the texts that are no near copies of an earlier one with the same label, by sketches of the least hashes of their words."""
    keep, known, sketches = [], {}, []
    at = 0
    for _, _, data, offsets in slices(pa.array(texts, pa.large_string())):
        words = Words(data, offsets, LETTERS)
        for s, e in zip(words.first[:-1], words.first[1:], strict=True):
            own = set(np.unique(words.hash[s:e])[:SKETCH].tolist())
            lead = sorted(own)[:4]
            near = {i for h in lead for i in known.get((h, int(y[at])), ())}
            if not any(len(own & sketches[i]) >= ALIKE * max(len(own), len(sketches[i])) for i in near) or not own:
                for h in lead:
                    known.setdefault((h, int(y[at])), []).append(len(sketches))
                sketches.append(own)
                keep.append(at)
            at += 1
    return np.array(keep, dtype=np.int64)


def learn_lexicon(texts: list[str], y: np.ndarray) -> Grammar:
    """A grammar with the insults that the texts teach, and the base lexicon as far as they don't contradict it.

    A word is learned if it is in more toxic texts than chance allows. For a beginning the different words
    with it are counted in each text, as an insult's forms are many but each of them is rare.
    """
    fixed = {_hash_of(w): 2.0 for w in INSULTS}
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if n1 and n0:
        table = np.empty(0, dtype=np.uint64)
        counts = np.empty((0, 4))  # texts and words of texts: toxic, other
        totals = np.zeros(2)
        for first, last, data, offsets in slices(pa.array(texts, pa.large_string())):
            words = Words(data, offsets, LETTERS)
            entries = _entries(words)
            doc = np.repeat(np.arange(first, last), words.counts())
            once = np.unique(mix(entries[:, 0] + doc.astype(np.uint64) * _SPREAD), return_index=True)[1]  # each word once a text
            entries, doc = entries[once], doc[once]
            totals += np.bincount(y[doc], minlength=2)
            doc = np.repeat(doc, entries.shape[1])
            entries = entries.ravel()
            doc, entries = doc[entries != 0], entries[entries != 0]
            once = np.unique(mix(entries + doc.astype(np.uint64) * _SPREAD), return_index=True)[1]
            own, slot = np.unique(entries, return_inverse=True)
            new = np.zeros((len(own), 4))
            for k, pick in ((0, once), (2, slice(None))):
                marks = y[doc[pick]]
                new[:, k] = np.bincount(slot[pick], weights=marks, minlength=len(own))
                new[:, k + 1] = np.bincount(slot[pick], weights=1 - marks, minlength=len(own))
            table, slot = np.unique(np.concatenate([table, own]), return_inverse=True)
            both = np.concatenate([counts, new])
            counts = np.stack([np.bincount(slot, weights=both[:, k], minlength=len(table)) for k in range(4)], axis=1)
        df1, df0, w1, w0 = counts.T
        odds = np.log((df1 + 0.5) / (n1 + 1)) - np.log((df0 + 0.5) / (n0 + 1))
        ratio = np.maximum(_ratio(df1, df0, n1, n0), _ratio(w1, w0, totals[1], totals[0]))
        good = (odds >= LEAST_ODDS) & (df1 >= LEAST_TEXTS) & (ratio >= 2 * np.log(max(2, len(table))) + MARGIN)
        slot = _member(np.array(list(fixed), dtype=np.uint64), table)
        known = {k: (odds[i], df1[i] + df0[i]) for k, i in zip(fixed, slot.tolist(), strict=True) if i >= 0}
        fixed = {k: (max(0.0, known[k][0]) if k in known and known[k][1] >= 20 else w) for k, w in fixed.items()}
        fixed |= dict(zip(table[good].tolist(), odds[good].tolist(), strict=True))
    lexicon = sorted((k, w) for k, w in fixed.items() if w > 0)
    return Grammar(np.array([k for k, _ in lexicon], dtype=np.uint64), np.array([w for _, w in lexicon]))


def _measure(grammar: Grammar, texts: list[str]) -> np.ndarray:
    rows = [np.empty((0, len(KINDS) + 1))]
    for _, _, data, offsets in slices(pa.array(texts, pa.large_string())):
        words = Words(data, offsets, LETTERS)
        rows.append(_features(*matches(grammar, words)[:2], words.counts()))
    return np.vstack(rows)


def train(texts: list[str], toxic: list[int], prior: float | None = None) -> Grammar:
    """A grammar from labelled texts, of near copies with one label the first. prior: share of toxic texts where it is not that of the sample."""
    y = np.array(toxic, dtype=np.int64)
    keep = first_of_near_copies(texts, y)
    texts, y = [texts[i] for i in keep], y[keep]
    grammar = learn_lexicon(texts, y)
    halves = [np.arange(k, len(y), 2) for k in (0, 1)]
    if all(0 < y[h].sum() < len(h) for h in halves):
        x = np.zeros((len(y), len(KINDS) + 1))
        for h, other in (halves, halves[::-1]):
            x[h] = _measure(learn_lexicon([texts[i] for i in other], y[other]), [texts[i] for i in h])
        grammar.coef, grammar.bias = _logistic(x, y)
        if prior is not None:
            rate = y.mean()
            prior = min(max(prior, 1e-4), 1 - 1e-4)
            grammar.bias += float(np.log(prior / (1 - prior)) - np.log(rate / (1 - rate)))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE, sample_clean: int = SAMPLE_CLEAN) -> Grammar:
    """A grammar learned from labelled documents: about ``sample`` toxic and ``sample_clean`` other texts, chosen by hash.

    Null texts, labels and ids are left out; of repeated labels of an id the largest holds, of texts that
    are near copies with the same label the first in the order of the hash. The driver reads the texts in
    that order until it has SAMPLE_BYTES of them. An empty table teaches nothing beyond the base lexicon.
    """
    marks = labels.where(F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(toxic_col).cast("int")).alias("y"))
    n = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    keyed = marks.withColumn("h", F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    share = F.when(F.col("y") == 1, F.lit(sample / max(1, n.get(1, 0)))).otherwise(F.lit(sample_clean / max(1, n.get(0, 0))))
    # A Bernoulli sample of ids by hash, and a hard bound on it: at most so many ids are broadcast, and the texts stay where they are.
    few = F.broadcast(keyed.where(F.col("h") < share).select("__id", "y", "h").orderBy("h", "__id").limit(2 * (sample + sample_clean)))
    some = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.lower(text_col).alias("t")).join(few, F.col("i") == F.col("__id")).select("h", "i", "y", "t")
    texts, ys, size = [], [], 0
    for r in some.orderBy("h", "i").limit(2 * (sample + sample_clean)).toLocalIterator():
        size += len(r.t)
        if size > SAMPLE_BYTES:
            break
        texts.append(r.t)
        ys.append(int(r.y == 1))
    total = sum(n.values())
    return train(texts, ys, n.get(1, 0) / total if total else None)


def score_toxicity(docs: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1), matches (clause's first word, word, kind, weight; word numbers from 0).

    Null and empty texts have no matches and so the score of an unmatched text. Repeated rows give
    repeated results, an empty table gives an empty one, and other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, LETTERS)
                sums, full, found = matches(own, words)
                z = _features(sums, full, words.counts()) @ own.coef + own.bias
                by_doc: list[list] = [[] for _ in range(last - first)]
                for s, w, k, v in found:
                    d = int(np.searchsorted(words.first, s, side="right")) - 1
                    base = int(words.first[d])
                    by_doc[d].append({"clause": s - base, "word": w - base, "kind": KINDS[k], "weight": v})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))),
                        pa.array(by_doc, pa.list_(pa.struct([("clause", pa.int64()), ("word", pa.int64()), ("kind", pa.string()), ("weight", pa.float64())]))),
                    ],
                    names=[id_col, "score", "matches"],
                )

    schema = f"`{id_col}` {kind}, score double, matches array<struct<clause: bigint, word: bigint, kind: string, weight: double>>"
    return bounded(docs).select(F.col(id_col), F.lower(F.col(text_col).cast("string"))).mapInArrow(score, schema)
