"""Language identification of code-switched text by a linear-chain conditional random field over words.

A word's features are its affixes (first and last one to four bytes), the three- and four-byte strings
inside it and the whole word, all lower-cased and hashed into a table of learned weights, one for each
label, and the language whose lexicon has the word; a lexicon holds the words that several sampled
documents of one language share and those of others hardly use. Labels are the languages and one for
words of none, which random strings of letters, digits and signs teach. Adjacent labels have learned
transition weights. Training sequences are documents and spliced ones, in which runs of words of other
languages or of none follow, so that the transitions learn how often text switches. Labels of words come
from forward-backward, computed for all documents of a slice at once: products of small matrices for
blocks of words first, then over the blocks of each document, then inside the blocks.

The model is fitted on at most ``SAMPLE`` labelled documents a language and ``SAMPLE_WORDS`` words of
each, in runs from its whole length, a bounded, deterministic sample by hash; predictions read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import bounded
from .textscan import NOT_SPACE, Words, mix, prefix_hashes, range_hashes, slices

#: Bounds of the training sample: documents a language and words of a document.
SAMPLE, SAMPLE_WORDS = 400, 150
#: Runs of words that are taken from a document of more words.
RUNS = 6
#: Documents of a language that a lexicon's word is in at least, and the least share of all its documents.
LEXICON_DOCS, LEXICON_SHARE = 3, 0.9
#: Share of training sequences that a run of random words goes into, and of those that are nothing else.
NOISE, ALL_NOISE = 0.15, 0.03
TABLE_BITS = 17
EPOCHS = 6
BLOCK = 64
#: Bytes of text that are labelled at once: a word has about fifteen features, each with a row of weights.
SLICE = 400_000
UNKNOWN = "und"
#: Share of the words that a kept text's language has, and how much less is enough for one word. Set on held-out documents of
#: the tables: none of 788 falls short, while texts of two languages in equal parts have a share of about 0.5.
LEAST, DOUBT = 0.8, 0.9


@dataclass
class Field:
    """Languages, emission weights [table, labels], transition weights [labels, labels], start weights [labels], and the lexicon.

    Labels are the languages and, as the last one, words of none. lexicon: hashes of words in order, and their languages' numbers.
    """

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray] = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))


def _word_hashes(words: Words) -> np.ndarray:
    return mix(range_hashes(prefix_hashes(words.data), words.start, words.end) + np.uint64(99))


def feature_rows(words: Words, lexicon: tuple[np.ndarray, np.ndarray] = Field.lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table that the words' features name, and where each word's rows begin."""
    c = prefix_hashes(words.data)
    s, e = words.start, words.end
    kinds = []
    for n in (1, 2, 3, 4):
        at = np.minimum(s + n, e)
        kinds.append(mix(range_hashes(c, s, at) + np.uint64(2 * n)))
        kinds.append(mix(range_hashes(c, np.maximum(e - n, s), e) + np.uint64(2 * n + 1)))
    whole = mix(range_hashes(c, s, e) + np.uint64(99))
    kinds.append(whole)
    listed = np.zeros(len(s), dtype=np.uint64)  # the number of the language whose lexicon has the word, from 1
    if len(lexicon[0]):
        at = np.minimum(np.searchsorted(lexicon[0], whole), len(lexicon[0]) - 1)
        listed = np.where(lexicon[0][at] == whole, lexicon[1][at] + 1, 0).astype(np.uint64)
    kinds.append(mix(listed + np.uint64(5000)))
    fixed = np.stack(kinds, axis=1) if len(s) else np.empty((0, 10), dtype=np.uint64)
    grams, counts = [], []
    for n in (3, 4):
        many = np.maximum(0, e - s - n + 1)
        word = np.repeat(np.arange(len(s)), many)
        at = s[word] + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        grams.append(mix(range_hashes(c, at, at + n) + np.uint64(1000 + n)))
        counts.append(many)
    total = 10 + counts[0] + counts[1]
    first = np.concatenate([[0], np.cumsum(total)])
    rows = np.empty(int(first[-1]), dtype=np.uint64)
    for k in range(10):
        rows[first[:-1] + k] = fixed[:, k]
    skip = np.full(len(s), 10)
    for g, many in zip(grams, counts, strict=True):
        at = np.repeat(first[:-1] + skip, many) + np.arange(len(g)) - np.repeat(np.cumsum(many) - many, many)
        rows[at] = g
        skip = skip + many
    return (rows >> np.uint64(64 - TABLE_BITS)).astype(np.int64), first


def emissions(field: Field, words: Words) -> np.ndarray:
    """[words, labels]: summed weights, divided by the root of the number of features so that long words don't drown out their neighbours."""
    rows, first = feature_rows(words, field.lexicon)
    if not len(words.start):
        return np.zeros((0, len(field.start)))
    sums = np.add.reduceat(field.weights[rows], first[:-1], axis=0)
    return sums / np.sqrt(np.diff(first))[:, None]


def posteriors(field: Field, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[words, labels]: label probabilities by forward-backward for sequences first[d] : first[d + 1]."""
    n, k = emit.shape
    if not n:
        return emit
    pot = np.exp(emit - emit.max(axis=1, keepdims=True))
    move, start = np.exp(field.moves), np.exp(field.start)
    sizes = np.diff(first)
    blocks = -(-sizes // BLOCK)
    seq = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[seq] + nth * BLOCK
    many = np.minimum(BLOCK, first[seq + 1] - begin)
    # Potentials of each block, padded with ones; padded steps are the identity.
    step = np.arange(BLOCK)
    real = step < many[:, None]
    p = np.where(real[:, :, None], pot[np.minimum(begin[:, None] + step, n - 1)], 1.0)
    prod = np.broadcast_to(np.eye(k), (len(seq), k, k)).copy()  # state before the block -> unnormalised state after it
    opening = (nth == 0)[:, None]
    for t in range(BLOCK):
        nxt = np.matmul(prod, move)
        if t == 0:  # a document's first word has start weights in place of a move
            nxt = np.where(opening[:, :, None], prod.sum(axis=2, keepdims=True) * start, nxt)
        nxt = nxt * p[:, t, None, :]
        prod = np.where(real[:, t, None, None], nxt / nxt.sum(axis=(1, 2), keepdims=True), prod)
    # Over the blocks of each document: what comes before and after each block.
    head, tail = np.ones((len(seq), k)), np.ones((len(seq), k))
    at, left = np.cumsum(blocks) - blocks, blocks.copy()
    for b in range(int(blocks.max(initial=0))):
        on = np.flatnonzero(left > b)
        i = at[on] + b
        if b:
            v = np.einsum("ni,nij->nj", head[i - 1], prod[i - 1])
            head[i] = v / v.sum(axis=1, keepdims=True)
        j = at[on] + left[on] - 1 - b
        if b:
            v = np.einsum("nij,nj->ni", prod[j + 1], tail[j + 1])
            tail[j] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((len(seq), BLOCK, k))
    v = head
    for t in range(BLOCK):
        nxt = v @ move
        if t == 0:
            nxt = np.where(opening, v.sum(axis=1, keepdims=True) * start, nxt)
        nxt = nxt * p[:, t]
        v = np.where(real[:, t, None], nxt / nxt.sum(axis=1, keepdims=True), v)
        alpha[:, t] = v
    beta = np.empty((len(seq), BLOCK, k))
    v = tail
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = v
        nxt = (v * p[:, t]) @ move.T
        v = np.where(real[:, t, None], nxt / nxt.sum(axis=1, keepdims=True), v)
    out = (alpha * beta)[real]
    return out / out.sum(axis=1, keepdims=True)


def random_words(rng: np.random.Generator, n: int) -> list[bytes]:
    """n words of no language: letters, hexadecimal digits, or letters, digits and signs by chance."""
    kinds = (b"abcdefghijklmnopqrstuvwxyz", b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    out = []
    for _ in range(n):
        letters = np.frombuffer(kinds[int(rng.integers(3))], dtype=np.uint8)
        out.append(rng.choice(letters, int(rng.integers(3, 20))).tobytes())
    return out


def _joined(docs: list[list[bytes]]) -> Words:
    raw = [b" ".join(d) for d in docs]
    return Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), NOT_SPACE)


def learn_lexicon(docs: list[tuple[list[bytes], int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that mark one of k languages, in order, and the languages' numbers."""
    words = _joined([d for d, _ in docs])
    doc = np.repeat(np.arange(len(docs)), words.counts())
    pairs = np.unique(np.stack([_word_hashes(words), doc.astype(np.uint64)]), axis=1)  # each word once a document
    keys, slot = np.unique(pairs[0], return_inverse=True)
    label = np.array([y for _, y in docs], dtype=np.int64)[pairs[1].astype(np.int64)]
    counts = np.bincount(slot * k + label, minlength=len(keys) * k).reshape(len(keys), k)
    top = counts.max(axis=1)
    good = (top >= LEXICON_DOCS) & (top >= LEXICON_SHARE * counts.sum(axis=1))
    return keys[good], counts.argmax(axis=1)[good]


def train(sequences: list[tuple[str, str]], labels: list[str], epochs: int = EPOCHS, seed: int = 5) -> Field:
    """A field from (text, label) pairs by stochastic gradient steps on the sequences' log-likelihood (AdaGrad)."""
    k = len(labels) + 1
    field = Field(labels, np.zeros((1 << TABLE_BITS, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k))
    if not sequences or not labels:
        return field
    rng = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(labels)}
    words = [([w.encode() for w in t.lower().split()], code[y]) for t, y in sequences]
    words = [x for x in words if x[0]]
    field.lexicon = learn_lexicon(words, k)
    g_w = np.full(field.weights.shape, 1e-3, dtype=np.float32)
    g_m, g_s = np.full((k, k), 1e-3), np.full(k, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for cut in range(0, len(order), 32):
            seqs, gold = [], []
            pick = order[cut : cut + 32]
            for i in pick:
                own, y = words[i]
                parts, ys = [own], [y] * len(own)
                if rng.random() < 0.4:  # splice: a run of another document goes in
                    more, z = words[int(rng.integers(len(words)))]
                    a = int(rng.integers(0, len(own) + 1))
                    b = int(rng.integers(1, min(len(more), 40) + 1))
                    parts, ys = [own[:a], more[:b], own[a:]], [y] * a + [z] * b + [y] * (len(own) - a)
                chance = rng.random()
                if chance < NOISE + ALL_NOISE:
                    noise = random_words(rng, int(rng.integers(1, 20)))
                    a = int(rng.integers(0, len(ys) + 1)) if chance < NOISE else 0
                    flat = [w for part in parts for w in part] if chance < NOISE else []
                    parts, ys = [flat[:a], noise, flat[a:]], [*ys[:a], *[k - 1] * len(noise), *ys[a : len(flat)]]
                seqs.append([w for part in parts for w in part])
                gold += ys
            w = _joined(seqs)
            rows, first = feature_rows(w, field.lexicon)
            scale = 1 / np.sqrt(np.diff(first))
            emit = np.add.reduceat(field.weights[rows], first[:-1], axis=0) * scale[:, None]
            post = posteriors(field, emit.astype(np.float64), w.first)
            y = np.array(gold)
            diff = -post
            diff[np.arange(len(y)), y] += 1
            # Emissions; every feature of a word shares the word's error.
            grad = np.zeros_like(field.weights)
            np.add.at(grad, rows, np.repeat(diff * scale[:, None], np.diff(first), axis=0).astype(np.float32))
            hit = np.unique(rows)
            g = grad[hit] / len(seqs) - 1e-5 * field.weights[hit]
            g_w[hit] += g * g
            field.weights[hit] += 0.5 * g / np.sqrt(g_w[hit])
            # Moves: gold counts less expected ones, the latter from pairwise marginals.
            inner = np.ones(len(y), dtype=bool)
            inner[w.first[:-1]] = False
            b = np.flatnonzero(inner)
            pair = pairwise(field, emit.astype(np.float64), post, b)
            gm = -pair
            np.add.at(gm, (y[b - 1], y[b]), 1)
            gm = gm / len(seqs) - 1e-3 * field.moves
            g_m += gm * gm
            field.moves += 0.2 * gm / np.sqrt(g_m)
            gs = diff[w.first[:-1]].mean(axis=0)
            g_s += gs * gs
            field.start += 0.2 * gs / np.sqrt(g_s)
    return field


def pairwise(field: Field, emit: np.ndarray, post: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Summed P(label before, label) over the words at, from node marginals.

    alpha(t-1) is in proportion to post(t-1) / beta(t-1), and beta(t-1) follows from beta(t) * potential(t)
    up to scale; both reduce to post(t-1) and the share of post(t) that each label before it explains.
    """
    if not len(at):
        return np.zeros_like(field.moves)
    # P(y | x_before) is in proportion to move[x, y] * r(y), where r makes the marginals agree: post(t) = sum_x post(t-1, x) P(y | x).
    move = np.exp(field.moves)
    p, q = post[at - 1], post[at]
    r = np.exp(emit[at] - emit[at].max(axis=1, keepdims=True))
    for _ in range(8):
        z = r @ move.T
        r = q / np.maximum(((p / np.maximum(z, 1e-300)) @ move), 1e-300)
    z = np.maximum(r @ move.T, 1e-300)
    return move * np.einsum("ni,nj->ij", p / z, r)


def fold(column: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo parts."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Field:
    """A field learned from the first ``sample`` labelled texts of each language, in the order of a hash of id and text.

    Rows without text, label or a letter are left out. The sample that reaches the driver has at most
    ``sample`` texts a language, and of texts of more than SAMPLE_WORDS words RUNS runs at even distances
    from the first to the last, which have as many words in all.
    """
    run = SAMPLE_WORDS // RUNS
    spread = lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda i: F.slice(w, 1 + F.floor(i * (F.size(w) - run) / (RUNS - 1)).cast("int"), run)))
    some = F.transform(F.array(F.split(F.col(text_col), r"\s+")), lambda w: F.when(F.size(w) <= SAMPLE_WORDS, w).otherwise(spread(w)))
    text = F.array_join(F.element_at(some, 1), " ")
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    keyed = usable.select(F.col(lang_col).cast("string").alias("y"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col))
    # The k least hashes of a language: a bounded aggregate with map-side combining, not a sort of each language.
    counts = keyed.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    near = keyed.join(F.broadcast(counts.withColumn("share", F.lit(3.0 * sample) / F.col("n"))) if counts.count() <= 10_000 else counts.withColumn("share", F.lit(3.0 * sample) / F.col("n")), "y")
    near = near.where(F.pmod(F.col("h"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("y", "h", text.alias("t"))
    rows = near.groupBy("y").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "t"))), 1, sample).alias("all")).select("y", F.explode("all").alias("x")).select("y", "x.h", "x.t").collect()
    rows.sort(key=lambda r: (r.h, r.y))
    return train([(r.t, r.y) for r in rows], sorted({r.y for r in rows}))


def predict(own: Field, texts: pa.Array, some: np.ndarray, spans: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list, np.ndarray]]:
    """(first row, last row + 1, best label numbers, scores, shares, spans, words with a letter) for slices of lower-cased texts; the number after the last language is ``und``. Shares are of all words with a letter, those of no language included."""
    k = len(own.labels)
    for first, last, data, offsets in slices(texts, SLICE):
        n = last - first
        best, score, shares, runs, weight = np.full(n, k), np.zeros(n), np.zeros((n, k)), [[] for _ in range(n)], np.zeros(n)
        if k:
            words = Words(data, offsets, NOT_SPACE)
            post = posteriors(own, emissions(own, words), words.first)
            # Letters are told from digits and signs by bytes: ASCII letters, or any non-ASCII byte.
            letter = np.concatenate([[0], np.cumsum((words.data >= 0x80) | ((words.data >= 0x61) & (words.data <= 0x7A)))])
            spoken = letter[words.end] > letter[words.start]
            sums = np.concatenate([np.zeros((1, k + 1)), np.cumsum(post * spoken[:, None], axis=0)])
            total = sums[words.first[1:]] - sums[words.first[:-1]]
            weight = total.sum(axis=1)
            ok = some[first:last].astype(bool) & (weight > 1e-9)
            shares[ok] = (total[ok] / weight[ok, None])[:, :k]
            best[ok], score[ok] = shares[ok].argmax(axis=1), np.clip(shares[ok].max(axis=1), 0, 1)
            if spans:
                likely = post.argmax(axis=1) if len(post) else np.empty(0, dtype=np.int64)
                for d in np.flatnonzero(ok):
                    s, e = words.first[d], words.first[d + 1]
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(likely[s:e])) + 1, [e - s]])
                    runs[d] = [{"lang": [*own.labels, UNKNOWN][likely[s + a]], "start": int(a), "end": int(b)} for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield first, last, best, score, shares, runs, weight


def _read(text_col: str) -> tuple[Column, Column]:
    """The lower-cased text, and whether it has a letter."""
    return F.lower(F.col(text_col).cast("string")).alias("__lower"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__some")


def identify(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row per row of docs: id, lang_pred, score, shares (expected share of words a language), and with spans the labelled word runs.

    lang_pred is the language with the largest expected number of words, ties to the first in order,
    and score its share. Null texts and texts without a letter are ``und`` with score 0, and so is
    everything where nothing could be learned. Words without a letter take no part in the shares.
    Spans are runs of words of one most likely language or of none (``und``): (lang, first word, word
    after the last). Repeated rows give repeated results, an empty table gives an empty one, and other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array([*own.labels, UNKNOWN], dtype=object)
        k = len(own.labels)
        for batch in batches:
            for first, last, best, score, shares, runs, _ in predict(own, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False), spans):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(names[best].tolist(), pa.string()),
                        pa.array(score),
                        pa.array([[] if b == k else [{"lang": x, "share": float(v)} for x, v in zip(own.labels, row, strict=True)] for b, row in zip(best, shares, strict=True)], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                        pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=[id_col, "lang_pred", "score", "shares", "spans"],
                )

    schema = f"`{id_col}` {kind}, lang_pred string, score double, shares array<struct<lang: string, share: double>>, spans array<struct<lang: string, start: bigint, end: bigint>>"
    out = bounded(docs).select(F.col(id_col), *_read(text_col)).mapInArrow(label, schema)
    return out if spans else out.drop("spans")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST, doubt: float = DOUBT) -> DataFrame:
    """docs without the rows that are ``und`` or whose language has too small a share of the words; columns as in docs, no shuffle.

    The share must reach ``least`` less ``doubt`` over the root of the number of words with a letter: a few words tell little.

    The field is learned from the rows of docs that have a language and are not in fold 0 of 5. Where no
    row has a language, nothing can be told and every row with a letter stays. So texts that
    mix languages go, and texts of words of no language or of one that isn't learned. Null texts and texts without a
    letter go. Repeated rows share their fate, an empty table stays empty.
    """
    field = fit(docs.where(fold(F.col(id_col), 5) != 0), id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not field.labels:
        return docs.where(_read(text_col)[1])
    sent = docs.sparkSession.sparkContext.broadcast(field)
    width = len(docs.columns)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for first, last, best, score, _, _, words in predict(sent.value, batch.column(width), batch.column(width + 1).to_numpy(zero_copy_only=False)):
                keep[first:last] = (best < len(field.labels)) & (score >= least - doubt / np.sqrt(np.maximum(words, 1)))
            yield batch.select(list(range(width))).filter(pa.array(keep))

    taken = {c.lower() for c in docs.columns}
    names = [n for n in (f"__{i}" for i in range(len(taken) + 2)) if n not in taken]
    return bounded(docs).select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(_read(text_col), names, strict=False)]).mapInArrow(sift, docs.schema)
