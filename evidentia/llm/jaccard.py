"""N-gram Jaccard join over signature trees.

A document's set holds its distinct five-word shingles as 64-bit hashes. Documents of equal words form a
class, told by a 128-bit BLAKE2b digest of the words, and only one representative of a class goes on.
What is compared with what comes from blocks: representatives that agree on one of ``BANDS`` bands of
``ROWS`` min-hashes. A pair at the threshold misses all bands with a probability of 1e-8, a pair above it
with less; nothing else is approximate.

Candidates are found by signature trees, whose nodes hold the OR of the bitmaps, the range of sizes and
the component below them. A dual traversal of two trees drops the node pairs whose largest possible
overlap is too small for a link or which are one component already; leaf pairs that are left are counted
on the whole sets, and the words themselves are compared before a link holds. There are three steps.

* Leader round: each representative goes to the block leader that it meets most often. A leader's tree is
  traversed against the tree of its members, so a group of m copies costs m comparisons, not m * m.
* Nearest rounds: each block that still holds several components is traversed against itself, and only
  the closest partner of each representative in another component is compared.
* Full round: every leaf pair that is left is compared.

Blocks of more than ``TILE`` representatives are dealt out in tiles by size and a hash, and each pair of
tiles whose sizes allow a link is a task, so that no task holds a block, however large. As pairs inside a
component cannot change it, components are those of all links.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import connected_components
from .spark_io import bounded, cut_lineage, fitted
from .textscan import NOT_SPACE, Words, mix, slices

GRAM = 5
SIMILARITY = 75  # percent
BANDS, ROWS = 48, 4
FANOUT = 8
#: Node pairs that are expanded at once, and members that one task compares with a leader.
CHUNK, SALT = 65_536, 1_000
#: Representatives of a block that are traversed as a whole, ratio of the sizes of a tile (a little over that of linked sets), members of a leader that form a tree.
TILE, RATIO, GROVE = 4_000, 1.34, 256
#: Block entries, texts and pairs that one task handles at least.
ENTRIES, TEXTS, PAIRS = 20_000, 5_000, 2_000

_ROLL = np.uint64(0xA0761D6478BD642F | 1)
_RNG = np.random.default_rng(977)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _shingles(h: np.ndarray, gram: int, own: int) -> np.ndarray:
    """Hashes of all runs of gram words; own is gram, or the number of words of a document that has fewer than GRAM."""
    full = np.full(max(0, len(h) - gram + 1), own if own < GRAM else 0, dtype=np.uint64)
    for j in range(gram):
        full = full * _ROLL + h[j : j + len(full)]
    return mix(full)


def shingle_sets(words: Words, gram: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    h = words.hash
    full = _shingles(h, gram, gram)
    out = []
    for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if e - s >= gram:
            out.append(np.unique(full[s : e - gram + 1]))
        elif e > s:
            out.append(_shingles(h[s:e], e - s, e - s))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def word_keys(words: Words) -> np.ndarray:
    """int64 [documents, 2]: a digest of each document's words, 0 where there are none."""
    data, at = words.plain()
    raw = data.tobytes()
    digests = [hashlib.blake2b(raw[s:e], digest_size=16).digest() if e > s else bytes(16) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), dtype=np.int64).reshape(len(digests), 2)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap of eight times as many bits as tokens at least, a power of two and 64 or more."""
    bits = 1 << max(6, int(8 * len(tokens) - 1).bit_length())
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """int64 keys [sets, BANDS] of non-empty sets."""
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, dtype=np.uint64)
        for r in range(b * ROWS, b * ROWS + ROWS):
            key = mix(key * _ROLL + np.minimum.reduceat((low ^ _XOR[r]) * _MUL[r], at))
        out[:, b] = key
    return out.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(1)):
            words = Words(data, offsets, NOT_SPACE)
            sets, keys = shingle_sets(words), word_keys(words)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [[]] * len(sets)
            if full:
                for i, own in zip(full, band_keys([sets[i] for i in full]), strict=True):
                    bands[i] = own
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "n", "s", "x", "bands"],
            )


class SignatureTree:
    """Representatives of one block, sorted by size. Level 0 are the leaves; every level above ORs FANOUT nodes of the one below."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, part: np.ndarray):
        self.order = np.lexsort((part, n))
        n, bits, part = n[self.order], bits[self.order], part[self.order]
        hidden = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)  # tokens that share another's bit
        self.levels = [(n, n, hidden, bits, part)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, hid, bit, prt = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            one = np.minimum.reduceat(prt, at)
            one = np.where(one == np.maximum.reduceat(prt, at), one, -1)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hid, at), np.bitwise_or.reduceat(bit, at, axis=0), one))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]

    def below(self, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children, at level k, of nodes at level k + 1, and whose they are."""
        if k + 1 >= len(self.levels):
            return nodes, np.arange(len(nodes))
        many = np.minimum(FANOUT, len(self.levels[k][0]) - nodes * FANOUT)
        own = np.repeat(np.arange(len(nodes)), many)
        return nodes[own] * FANOUT + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many), own


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether any documents below nodes i and j can be linked and are not one component yet; the largest similarity possible."""
    lo_a, hi_a, hid_a, bit_a, part_a = (x[i] for x in a)
    lo_b, hi_b, hid_b, bit_b, part_b = (x[j] for x in b)
    most = np.bitwise_count(bit_a & bit_b).sum(axis=1).astype(np.int64) + np.minimum(hid_a, hid_b)
    most = np.minimum(most, np.minimum(hi_a, hi_b))
    ok = (100 + SIMILARITY) * most >= SIMILARITY * (lo_a + lo_b)
    ok &= (100 * hi_a >= SIMILARITY * lo_b) & (100 * hi_b >= SIMILARITY * lo_a)
    return ok & ((part_a != part_b) | (part_a < 0)), most / np.maximum(1, lo_a + lo_b - most)


def dual_traversal(x: SignatureTree, y: SignatureTree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of entries (of x, of y) that may be linked, with their largest possible similarity; of one tree with itself each pair once."""
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > CHUNK:
            stack += [(k, i[:CHUNK], j[:CHUNK]), (k, i[CHUNK:], j[CHUNK:])]
            continue
        keep, most = may_link(x.level(k), i, y.level(k), j)
        if same and k == 0:
            keep &= i < j
        i, j, most = i[keep], j[keep], most[keep]
        if not len(i):
            continue
        if k == 0:
            yield x.order[i], y.order[j], most
            continue
        ci, own = x.below(k - 1, i)
        cj, who = y.below(k - 1, j[own])
        ci = ci[who]
        if same:
            half = ci <= cj
            ci, cj = ci[half], cj[half]
        stack.append((k - 1, ci, cj))


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _by_width(maps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Entries and their bitmaps by the bitmaps' number of 64-bit words."""
    width = np.array([len(m) // 8 for m in maps])
    out = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[w] = at, np.frombuffer(b"".join(maps[i] for i in at), dtype=np.uint64).reshape(len(at), w)
    return out


def block_pairs(n: np.ndarray, maps: list[bytes], part: np.ndarray, left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entry pairs of a block that may be linked; with left, pairs of an entry that it marks with one that it doesn't.

    Sizes of linked sets differ by a third at most, so their bitmaps by one doubling.
    """
    sides = [np.arange(len(n))] * 2 if left is None else [np.flatnonzero(left), np.flatnonzero(~left)]
    x, y = ({w: (side[at], bits) for w, (at, bits) in _by_width([maps[i] for i in side]).items()} for side in sides)
    for w, (at, bits) in x.items():
        for v in (w, 2 * w) if left is None else (w // 2, w, 2 * w):
            if v in y:
                more, wide = y[v]
                least = min(v, w)
                own = SignatureTree(n[at], _fold(bits, least), part[at])
                other = own if left is None and v == w else SignatureTree(n[more], _fold(wide, least), part[more])
                for i, j, most in dual_traversal(own, other):
                    yield at[i], more[j], most


def _traverse(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, right, node, part, n, bits), sorted by key, to pairs (a, b, most) of nodes; with nearest, one for each node b at most.

    Where some rows of a key are marked right, its pairs are those of a row that is with one that isn't.
    """
    held: list[pa.RecordBatch] = []

    def pairs(block: pa.Table) -> Iterator[pa.RecordBatch]:
        node = block.column("node").combine_chunks()
        part = np.unique([str(p) for p in block.column("part").to_pylist()], return_inverse=True)[1].astype(np.int64)
        right = block.column("right").to_numpy()
        found = block_pairs(block.column("n").to_numpy(), block.column("bits").to_pylist(), part, ~right if right.any() else None)
        if nearest:
            best, mate = np.full(len(part), -1.0), np.full(len(part), -1)
            for i, j, most in found:
                for x, y in ((i, j), (j, i)):
                    np.maximum.at(best, x, most)
                    top = most == best[x]
                    mate[x[top]] = y[top]
            on = np.flatnonzero(mate >= 0)
            found = iter([(mate[on], on, best[on])] if len(on) else [])
        for i, j, most in found:
            yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j)), pa.array(most)], names=["a", "b", "most"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and len(keys) and held[-1].column(0)[-1].as_py() != keys[0]:
            cuts = np.concatenate([[0], cuts])
        last = 0
        for c in cuts.tolist():
            if c > last:
                held.append(batch.slice(last, c - last))
            if held:
                yield from pairs(pa.Table.from_batches(held))
            held, last = [], c
        if batch.num_rows > last:
            held.append(batch.slice(last))
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (node, n, bits, z): set size, bitmap and compressed words under the representative's name."""
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(1)):
            words = Words(data, offsets, NOT_SPACE)
            sets, (plain, at) = shingle_sets(words), words.plain()
            texts = [zlib.compress(plain[s:e].tobytes(), 1) for s, e in zip(at[:-1], at[1:], strict=True)]
            node = pa.StructArray.from_arrays([batch.column(0).slice(first, last - first), pa.array(word_keys(words)[:, 0])], names=["id", "s"])
            yield pa.RecordBatch.from_arrays([node, pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.array(texts, pa.binary())], names=["node", "n", "bits", "z"])


class Shingled:
    """The words of one document, its shingles' hashes and where each first stands."""

    def __init__(self, z: bytes):
        self.raw = zlib.decompress(z)
        self.words = Words(np.frombuffer(self.raw, dtype=np.uint8), np.array([0, len(self.raw)]), NOT_SPACE)
        n = len(self.words.start)
        self.gram = min(GRAM, n)
        self.hash, self.at = np.unique(_shingles(self.words.hash, self.gram, n), return_index=True)

    def bytes_of(self, first: int, last: int) -> bytes:
        """Shingles first .. last as they stand."""
        return self.raw[self.words.start[first] : self.words.end[last + self.gram - 1]]

    def linked(self, other: Shingled) -> bool:
        """Whether the sets are similar enough; shingles of equal hash are compared word by word, in runs that go on in both texts."""
        enough = lambda both: 100 * both >= SIMILARITY * (len(self.hash) + len(other.hash) - both)
        _, i, j = np.intersect1d(self.hash, other.hash, assume_unique=True, return_indices=True)
        if not enough(len(i)):
            return False
        order = np.argsort(self.at[i])
        p, q = self.at[i][order], other.at[j][order]
        first = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(q) != 1)))
        last = np.append(first[1:], len(p)) - 1
        if self.gram == other.gram and all(self.bytes_of(p[a], p[b]) == other.bytes_of(q[a], q[b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)):
            return True
        sets = [{x.bytes_of(k, k) for k in range(len(x.words.start) - x.gram + 1)} for x in (self, other)]
        both = len(sets[0] & sets[1])  # a hash collision: count the shingles themselves
        return 100 * both >= SIMILARITY * (len(sets[0] | sets[1]))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, role, node, n, bits, z), leaders (role 0) before their members: the pairs (a, node) that are linked.

    Members of a leader form trees of at most GROVE leaves; what the traversal against the leader's tree leaves is compared.
    """
    group, head, leader = None, None, None
    held: list[tuple[pa.RecordBatch, int]] = []

    def grown() -> Iterator[pa.RecordBatch]:
        nonlocal held
        rows, held = held, []
        if not rows:
            return
        column = lambda name: [b.column(name)[i].as_py() for b, i in [head, *rows]]
        part = np.arange(len(rows) + 1)
        hits = []
        for _, j, _ in block_pairs(np.array(column("n")), column("bits"), part, part == 0):
            hits += [rows[k - 1] for k in sorted(j.tolist()) if leader.linked(Shingled(rows[k - 1][0].column("z")[rows[k - 1][1]].as_py()))]
        for batch, i in hits:
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, 1), batch.column("a").slice(i, 1)], names=["u", "v"])

    for batch in batches:
        a, salt, role = (batch.column(k).to_pylist() for k in range(3))
        for i in range(batch.num_rows):
            if (a[i], salt[i]) != group or len(held) == GROVE:
                yield from grown()
            if role[i] == 0:
                if (a[i], salt[i]) != group:
                    group, head, leader = (a[i], salt[i]), (batch, i), Shingled(batch.column("z")[i].as_py())
            elif (a[i], salt[i]) == group:
                held.append((batch, i))
        yield from grown()


def _confirm(pairs: DataFrame, texts: DataFrame, n_texts: int, node: str) -> DataFrame:
    """The pairs (a, b) that are linked, as (u, v). Members of a leader are dealt out in salted groups of about SALT."""
    n_pairs = pairs.count()
    few = lambda df: fitted(df, n_pairs, PAIRS)
    # Where texts are read, tasks follow their number too: few pairs may need texts from anywhere.
    wide = lambda df: df.coalesce(max(1, -(-n_pairs // PAIRS), -(-n_texts // TEXTS)))
    hot = cut_lineage(few(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SALT)))
    dealt = few(pairs.join(hot, "a", "left")).select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("m") / SALT), F.lit(1))).alias("salt"))
    rows = dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node")).unionByName(dealt.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node")))
    full = wide(rows.join(texts, "node")).select("a", "salt", "role", "node", "n", "bits", "z")
    return wide(full.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")).mapInArrow(_compare, f"u {node}, v {node}")


def _tiled(entries: DataFrame) -> DataFrame:
    """Block entries (key, m, ...) as (key, right, ...): those of a block of more than TILE go once to each pair of tiles that they are in.

    A tile is a range of sizes and a share by hash. Linked sizes lie in the same range or in adjacent
    ones, so a tile meets the other shares of its range and all shares of the next.
    """
    size, k = F.floor(F.log("n") / F.log(F.lit(RATIO))).cast("int"), F.ceil(F.col("m") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), k).cast("int")
    pair = lambda b, i, c, j, right: F.struct(F.xxhash64("key", b, i, c, j).alias("key"), right.alias("right"))
    shares = F.sequence(F.lit(0), k - 1)
    tiles = F.concat(
        F.transform(shares, lambda j: pair(size, F.least(own, j), size, F.greatest(own, j), j < own)),
        F.transform(shares, lambda j: pair(size, own, size + 1, j, F.lit(False))),
        F.transform(shares, lambda j: pair(size - 1, j, size, own, F.lit(True))),
    )
    at = F.when(F.col("m") > TILE, tiles).otherwise(F.array(F.struct(F.col("key"), F.lit(False).alias("right"))))
    return entries.withColumn("at", F.explode(at)).select("at.key", "at.right", "node", "part", "n", "bits")


def _linked(docs: DataFrame, id_col: str, text_col: str, star_rounds: int = 1, nearest_rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Signed rows (id, n, s, x) of docs and classes (n, s, x, node, top): top is the smallest node of the class's component."""
    kind = docs.schema[id_col].dataType.simpleString()
    node = f"struct<id: {kind}, s: bigint>"
    plain = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut_lineage(plain.mapInArrow(_signatures, f"id {kind}, n bigint, s bigint, x bigint, bands array<bigint>"))
    # Equal words are one class; its representative is its smallest (id, key of the words).
    classes = signed.where("n > 0").groupBy("n", "s", "x").agg(F.min(F.struct("id", "s")).alias("node"), F.first("bands").alias("bands")).select("n", "s", "x", "node", "bands")
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = cut_lineage(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"))
    blocks = cut_lineage(banded.join(shared, "key"))
    few = lambda df, n=blocks.count(): fitted(df, n, ENTRIES)
    blocks = few(blocks)
    met = cut_lineage(few(blocks.select("node").distinct()))
    texts = plain.join(met.select(F.col("node.id").alias("nid")).distinct(), F.col("id").eqNullSafe(F.col("nid")), "left_semi")
    texts = cut_lineage(texts.mapInArrow(_pack, f"node {node}, n bigint, bits binary, z binary").join(met, "node", "left_semi"))
    n_texts = met.count()
    texts = fitted(texts, n_texts, TEXTS)
    edges = docs.sparkSession.createDataFrame([], f"u {node}, v {node}")
    parts = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def placed() -> DataFrame:
        return few(blocks.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")))

    def traversed(nearest: bool) -> DataFrame:
        mixed = few(placed().groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("top"), F.count(F.lit(1)).alias("m")).where("low != top").select("key", "m"))
        entries = few(few(placed().join(mixed, "key")).join(texts.select("node", "n", "bits"), "node").select("key", "m", "node", "part", "n", "bits"))
        dealt = few(_tiled(entries))
        return few(dealt.repartition("key").sortWithinPartitions("key")).mapInArrow(lambda it: _traverse(it, nearest), f"a {node}, b {node}, most double")

    for _ in range(star_rounds):
        heads = few(placed().groupBy("key").agg(F.min(F.struct("part", "node")).alias("head"), F.max("part").alias("top")).where("head.part != top").select("key", "head"))
        meets = few(placed().join(heads, "key").where("part != head.part")).groupBy("node", F.col("head.node").alias("head")).agg(F.count(F.lit(1)).alias("m"))
        best = cut_lineage(few(meets.groupBy("node").agg(F.max(F.struct("m", "head")).alias("best")).select(F.col("best.head").alias("a"), F.col("node").alias("b"))))
        edges = edges.unionByName(cut_lineage(_confirm(best, texts, n_texts, node)))
        parts = connected_components(edges)
    for _ in range(nearest_rounds):
        best = cut_lineage(few(traversed(nearest=True).groupBy("b").agg(F.max(F.struct("most", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")))
        fresh = cut_lineage(_confirm(best, texts, n_texts, node))
        if fresh.isEmpty():
            break
        edges = edges.unionByName(fresh)
        parts = connected_components(edges)
    found = cut_lineage(few(traversed(nearest=False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    edges = edges.unionByName(cut_lineage(_confirm(found, texts, n_texts, node)))
    parts = connected_components(edges)
    return signed, classes.select("n", "s", "x", "node").join(parts, "node", "left").select("n", "s", "x", "node", F.coalesce("component", "node").alias("top"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 1, nearest_rounds: int = 2) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that links reach, itself included).

    Texts without words and null texts have an empty set and are linked with nothing. Rows of equal
    texts are linked. Rows that share an id but not a text are documents of their own. A null id sorts
    before all others. An empty table gives an empty one; other columns are ignored. The numbers of
    rounds change the work, not the result.
    """
    signed, classes = _linked(docs, id_col, text_col, star_rounds, nearest_rounds)
    named = classes.select("n", "s", "x", F.col("top.id").alias("component_id"))
    full = signed.where("n > 0").select("id", "n", "s", "x").join(named, ["n", "s", "x"])
    out = full.select("id", "n", "component_id").unionByName(signed.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the text, that column replaced by the size of its set and a key of its words."""
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(batch.num_columns - 1)):
            words = Words(data, offsets, NOT_SPACE)
            sets = shingle_sets(words)
            rest = [c.slice(first, last - first) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(s) for s in sets], pa.int64()), pa.array(word_keys(words)[:, 0])], names=[*batch.schema.names[:-1], "__n", "__s"])


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest node (id and key of the words). Columns as in docs.

    Rows without words are linked with nothing and all stay. Where rows share an id, null included, each
    is told by its own node; of rows of one node, which are linked, that of the smallest hash stays.
    """
    signed, classes = _linked(docs, id_col, text_col)
    heads = cut_lineage(classes.where("node = top").select("n", "s", "x", F.col("node.id").alias("__head")))
    stays = (F.col("n") == 0) | (F.col("__found") & F.col("id").eqNullSafe(F.col("__head")))
    marked = signed.select("id", "n", "s", "x").join(heads.withColumn("__found", F.lit(True)), ["n", "s", "x"], "left").withColumn("__stays", F.coalesce(stays, F.lit(False)))
    ids = cut_lineage(marked.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__m"), F.bool_or("__stays").alias("__any")).where("__any"))
    of = lambda chosen: docs.join(ids.where(chosen).select("__id"), docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
    left = of("__m = 1")
    if ids.where("__m > 1").isEmpty():
        return left
    again = of("__m > 1").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    fields = [F.col(f"__row.`{c}`") for c in docs.columns]
    schema = again.drop("__text").schema.add("__n", LongType()).add("__s", LongType())
    again = cut_lineage(again.mapInArrow(_keyed, schema))
    tops = heads.select(F.col("__head"), F.col("n").alias("__hn"), F.col("s").alias("__hs"))
    same = F.col("__id").eqNullSafe(F.col("__head")) & (F.col("__n") == F.col("__hn")) & (F.col("__s") == F.col("__hs"))
    key = F.xxhash64(*[c for c, f in zip(fields, docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()])
    first = again.where("__n > 0").join(tops, same, "left_semi").groupBy("__id", "__s").agg(F.min_by("__row", key).alias("__row"))
    kept = again.where("__n = 0").select("__row").unionByName(first.select("__row"))
    return left.unionByName(kept.select(*[c.alias(n) for c, n in zip(fields, docs.columns, strict=True)]))
