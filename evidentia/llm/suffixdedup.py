"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of ``WIDTH`` bytes that also starts anywhere else in the corpus.
Sorting all suffixes of a corpus moves it many times over, so only suffixes at anchors are sorted: the
anchor of a window of WIDTH bytes is its leftmost 32-byte string of the least hash, which depends on the
window alone. Equal windows have equal anchors, and neighbouring windows mostly share one, so a document
is cut into runs of windows (about one for 85 bytes) that are named by their anchor.

* Anchors that occur once are done: their windows are unique.
* Runs of equal bytes, told by a 128-bit BLAKE2b digest, are one kind. A kind that occurs more than once
  enters what follows twice; what is found for a kind holds for all its runs.
* The kinds that share an anchor meet in the anchor's bucket with their bytes. There the suffixes that
  start at the anchors, and the reversed texts that end there, are sorted by a mergesort. Two of them are
  compared by binary search for their longest common extension over prefix hashes, and the extensions
  found between neighbours are verified byte by byte. A window reaching o bytes to the left of its anchor
  is repeated if another run agrees on o bytes to the left and WIDTH - o to the right, which the two
  sorted orders tell by their neighbours' extensions.

A bucket of more than ``SPLIT`` kinds is split further, by the whole window: its windows are told by
BLAKE2b digests and counted with map-side aggregation, so that no group is gathered, however hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  is pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import bounded, cut_lineage
from .textscan import BASE_INV, mix, powers, prefix_hashes, range_hashes, slices

WIDTH = 200
GRAM = 32
#: Kinds of one anchor that are sorted in one place.
SPLIT = 5_000
#: Kinds that are sorted together in a task, at least; whole buckets only.
BLOCK = 4_000
#: Bytes of text that a worker cuts at once (or one longer text): each takes about a hundred bytes of arrays.
SLICE = 250_000


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """min(keys[p : p + w]) for every p, by prefix and suffix minima of blocks of w."""
    n = len(keys)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = keys
    rows = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def spans_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Maximal runs of window starts that share their anchor: (document, first start, last start, anchor, anchor hash)."""
    lengths = np.diff(offsets)
    w = width - gram + 1
    if len(data) < width or not (lengths >= width).any():
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none.view(np.uint64)
    c = prefix_hashes(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    grams = mix(range_hashes(c, at, at + gram))
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (sliding_min(keys, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc_of = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    ok = at[: len(anchor)] + width <= offsets[doc_of + 1]
    starts = np.flatnonzero(ok)
    anchor, doc = anchor[starts], doc_of[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi = starts[first], starts[last]
    return doc[first], lo, hi, anchor[first], grams[anchor[first]]


def _extension(c: np.ndarray, inverse: np.ndarray, i: np.ndarray, j: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The longest common extension of the suffixes at i and j, up to cap, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(i), dtype=np.int64), cap.copy()
    wi, wj, ci, cj = inverse[i], inverse[j], c[i], c[j]
    for _ in range(int(cap.max(initial=0)).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = (c[i + mid] - ci) * wi == (c[j + mid] - cj) * wj
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def sort_suffixes(data: np.ndarray, start: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes data[start : start + length] within consecutive buckets, and each one's common extension with the one before it (-1 at a bucket's first)."""
    c = prefix_hashes(data)
    inverse = powers(BASE_INV, len(c))
    tail = np.append(data, np.uint8(0))
    n = len(start)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    local = np.arange(n) - first
    order = np.arange(n)

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        cap = np.minimum(length[x], length[y])
        e = _extension(c, inverse, start[x], start[y], cap)
        end = e == cap
        bx, by = tail[start[x] + e], tail[start[y] + e]
        return np.where(end, np.where(length[x] == length[y], ties, length[x] < length[y]), bx < by)

    run = 1
    while run < sizes.max(initial=0):
        pos = np.flatnonzero(size > run)
        loc, base = local[pos], first[pos]
        own = loc // run * run
        pair = loc // (2 * run) * (2 * run)
        right = own > pair
        other = np.where(right, pair, pair + run)
        lo = np.zeros(len(pos), dtype=np.int64)
        hi = np.clip(size[pos] - other, 0, run)
        item = order[pos]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = before(order[base[open_] + other[open_] + mid], item[open_], right[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        merged = order.copy()
        merged[base + pair + loc - own + lo] = item
        order = merged
        run *= 2
    shared = np.full(n, -1, dtype=np.int64)
    inner = np.flatnonzero(local > 0)
    x, y = order[inner - 1], order[inner]
    shared[inner] = _extension(c, inverse, start[x], start[y], np.minimum(length[x], length[y]))
    if not _verified(tail, start, length, x, y, shared[inner]):
        return _sort_plainly(data, start, length, sizes)
    return order, shared


def _verified(tail: np.ndarray, start: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> bool:
    """Whether the bytes bear out the extensions and the order of neighbours x and y."""
    for k in range(0, len(x), 1024):
        a, b, e = x[k : k + 1024], y[k : k + 1024], shared[k : k + 1024]
        step = np.arange(int(e.max(initial=0)))
        inside = step < e[:, None]
        if (np.where(inside, tail[np.minimum(start[a][:, None] + step, len(tail) - 1)] != tail[np.minimum(start[b][:, None] + step, len(tail) - 1)], False)).any():
            return False
        open_ = e < np.minimum(length[a], length[b])
        if (tail[start[a] + e][open_] >= tail[start[b] + e][open_]).any() or (length[a] > length[b])[~open_].any():
            return False
    return True


def _sort_plainly(data: np.ndarray, start: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sort_suffixes() by the bytes themselves: what is left after a hash collision."""
    raw = data.tobytes()
    text = [raw[s : s + n] for s, n in zip(start.tolist(), length.tolist(), strict=True)]
    order, shared, at = [], [], 0
    for size in sizes.tolist():
        own = sorted(range(at, at + size), key=text.__getitem__)
        order += own
        for k, i in enumerate(own):
            t, u = text[own[k - 1]], text[i]
            shared.append(-1 if k == 0 else next((j for j, (p, q) in enumerate(zip(t, u, strict=False)) if p != q), min(len(t), len(u))))
        at += size
    return np.array(order, dtype=np.int64), np.array(shared, dtype=np.int64)


def repeated_offsets(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, sizes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """bool [runs, width]: whether the window that starts o bytes before the run's anchor occurs in another run of its bucket.

    data[offsets[i] : offsets[i + 1]] is run i from its first window's start to its last window's end,
    and anchor[i] the anchor's place in it. Runs of a bucket follow each other.
    """
    n = len(anchor)
    length = np.diff(offsets)
    at = offsets[:-1] + anchor
    right, ext_r = sort_suffixes(data, at, length - anchor, sizes)
    # The reversed buffer holds the runs from the last to the first; what stood before an anchor follows it there.
    left, ext_l = sort_suffixes(data[::-1].copy(), len(data) - at, anchor, sizes)
    most, least = anchor, anchor - (length - width)
    out = np.zeros((n, width), dtype=bool)
    class_r, class_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(int(least.min(initial=width)), int(most.max(initial=-1)) + 1):
        on = np.flatnonzero((least <= o) & (o <= most))
        class_r[right] = np.cumsum(ext_r < width - o)
        class_l[left] = np.cumsum(ext_l < o)
        key = class_r[on] * (n + 1) + class_l[on]
        by = np.argsort(key, kind="stable")
        same = np.zeros(len(on) + 1, dtype=bool)
        same[1:-1] = key[by[1:]] == key[by[:-1]]
        out[on[by[same[1:] | same[:-1]]], o] = True
    return out


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to the anchors of its runs."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0), SLICE):
            a = spans_of(data, offsets)[4]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64))], names=["a"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sig, text) to runs (a, s, id, sig, pos); s is the run's digest, pos packs the first start, and how far the last start and the anchor lie behind it."""
    for batch in batches:
        ids, sig = batch.column(0), batch.column(1)
        for first, _, data, offsets in slices(batch.column(2), SLICE):
            doc, lo, hi, anchor, a = spans_of(data, offsets)
            if len(doc):
                raw = data.tobytes()
                s = [_digest(raw[x:y]) for x, y in zip(lo.tolist(), (hi + WIDTH).tolist(), strict=True)]
                pos = ((lo - offsets[doc]) << 16) | ((hi - lo) << 8) | (anchor - lo)
                row = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s, pa.binary()), ids.take(row), sig.take(row), pa.array(pos)], names=["a", "s", "id", "sig", "pos"])


#: A kind with its bytes and the anchor's place in them, or an interval of a kind (f, t) counted from its start.
PART = "a bigint, s binary, at int, twice boolean, bytes binary, f int, t int"


def _solve(a: np.ndarray, s: pa.Array, at: np.ndarray, twice: np.ndarray, raw: pa.Array) -> pa.RecordBatch:
    """The repeated intervals (a, s, f, t) of kinds that stand in the order of their anchors, all kinds of an anchor together."""
    own = np.repeat(np.arange(len(a)), 1 + twice)
    pick = pa.array(own)
    a, at, column = a[own], at[own].astype(np.int64), raw.take(pick).cast(pa.large_binary())
    sizes = np.diff(np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)))
    _, off, buf = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]]
    found = repeated_offsets(data, off - off[0], at, sizes)
    found[np.append(False, own[1:] == own[:-1])] = False  # the second of two equal runs only lends its bytes
    edge = np.zeros((len(a), WIDTH + 2), dtype=np.int8)
    edge[:, 1:-1] = found
    turn = np.diff(edge, axis=1)
    run, near = np.nonzero(turn == 1)
    far = np.nonzero(turn == -1)[1] - 1
    return pa.RecordBatch.from_arrays([pa.array(a[run]), s.take(pa.array(own[run])), pa.array((at[run] - far).astype(np.int32)), pa.array((at[run] - near + WIDTH).astype(np.int32))], names=["a", "s", "f", "t"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, runs) to PART: kinds that are alone with their anchor are sorted here, the others go on with their bytes."""
    names = [c.split()[0] for c in PART.split(", ")]
    none = lambda n, kind: pa.nulls(n, kind)
    single: list[tuple] = []

    def solved() -> Iterator[pa.RecordBatch]:
        if single:
            a, s, at, twice, raw = zip(*single, strict=True)
            single.clear()
            got = _solve(np.array(a, dtype=np.int64), pa.array(s, pa.binary()), np.array(at), np.array(twice), pa.array(raw, pa.binary()))
            n = got.num_rows
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), none(n, pa.int32()), none(n, pa.bool_()), none(n, pa.binary()), got.column(2), got.column(3)], names=names)

    for batch in batches:
        rows: list[tuple] = []
        for raw, runs in zip(batch.column(0), batch.column(1), strict=True):
            raw = raw.as_py()
            for r in runs.as_py():
                p = r["pos"]
                own = raw[p >> 16 : (p >> 16) + (p >> 8 & 255) + WIDTH]
                (single if r["alone"] else rows).append((r["a"], _digest(own), p & 255, r["twice"], own))
            if len(single) >= BLOCK:
                yield from solved()
            if len(rows) >= BLOCK:
                yield _part(rows, names)
                rows = []
        if rows:
            yield _part(rows, names)
    yield from solved()


def _part(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    a, s, at, twice, raw = zip(*rows, strict=True)
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.binary()), pa.array(at, pa.int32()), pa.array(twice, pa.bool_()), pa.array(raw, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names=names)


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PART in the order of the anchors to repeated intervals (a, s, f, t): those that are there, and those of each bucket."""
    held: list[pa.RecordBatch] = []

    def solve() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        return _solve(rows.column("a").to_numpy(), rows.column("s").combine_chunks(), rows.column("at").to_numpy(), rows.column("twice").to_numpy(), rows.column("bytes").combine_chunks())

    count, before = 0, None
    for batch in batches:
        open_ = batch.column(4).is_valid()
        if not pa.compute.all(open_, min_count=0).as_py():
            yield batch.filter(pa.compute.invert(open_)).select(["a", "s", "f", "t"])
            batch = batch.filter(open_)
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        turns = np.flatnonzero(np.append(before is not None and keys[0] != before, keys[1:] != keys[:-1]))
        last, before = 0, keys[-1]
        # A block is closed at the first change of the anchor after BLOCK kinds.
        while len(ends := turns[(turns >= last + BLOCK - count) & (turns + count > last)]):
            held.append(batch.slice(last, int(ends[0]) - last))
            yield solve()
            held, count, last = [], 0, int(ends[0])
        held.append(batch.slice(last))
        count += batch.num_rows - last
    if count:
        yield solve()


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds with bytes to their windows: (h, a, s, f, many), the digest, place and number of each."""
    for batch in batches:
        for a, s, twice, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
            n = len(raw) - WIDTH + 1
            h = [_digest(raw[f : f + WIDTH]) for f in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array([a] * n, pa.int64()), pa.array([s] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([1 + twice] * n, pa.int64())], names=["h", "a", "s", "f", "many"])


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, runs) to the windows of their kinds, as _window_digests() gives them; in one step, since each step of a stage holds a Python worker of its own."""
    return _window_digests(_contexts(batches))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, intervals) to (id, n_bytes, spans, kept)."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()) if not pa.types.is_large_binary(batch.column(1).type) else batch.column(1)
        n_bytes, spans, kept = [], [], []
        for raw, cuts in zip(texts, batch.column(2).to_pylist(), strict=True):
            raw = raw.as_py() or b""
            gone: list[list[int]] = []
            for x in sorted((x["s"], x["e"]) for x in cuts or ()):
                if gone and x[0] <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], x[1])
                else:
                    gone.append(list(x))
            at, parts = 0, []
            for s, e in gone:
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at:])
            n_bytes.append(len(raw))
            spans.append([{"start": s, "end": e} for s, e in gone])
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """One row per row of docs: id, n_bytes, spans (maximal removed byte runs), kept (the other bytes).

    Null reads as the empty text; texts of fewer than WIDTH bytes keep everything. Repeated rows are
    documents of their own and so repeat each other. Rows are told apart by id and 128 bits of the text's
    SHA-256, so that ids may be null or repeated. An empty table gives an empty one; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("sig", F.coalesce(F.substring(F.unhex(F.sha2(F.col("text"), 256)), 1, 16), F.lit(bytearray(b"")))).select("id", "sig", "text")
    long = plain.where(F.octet_length("text") >= WIDTH)
    # Kept as a table of its own, so that both sides of the join are plain exchanges and Spark can split a hot anchor's runs.
    again = cut_lineage(long.select("text").mapInArrow(_anchors, "a bigint").groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"))
    met = cut_lineage(long.mapInArrow(_runs, f"a bigint, s binary, id {kind}, sig binary, pos bigint").join(again, F.col("a") == F.col("k")).drop("k"))
    # first() takes all three columns from one row; any run of its kind will do.
    kinds = cut_lineage(met.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c"), F.first("id").alias("i"), F.first("sig").alias("g"), F.first("pos").alias("pos")))
    buckets = cut_lineage(kinds.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("all")).where("all > 1"))
    # What meets where: a single kind is sorted with itself where its text is, several in their anchor's bucket, too many by window.
    detail = kinds.join(buckets, F.col("a") == F.col("k")).select("i", "g", F.struct("a", "pos", (F.col("c") > 1).alias("twice"), (F.col("m") == 1).alias("alone"), (F.col("m") > split).alias("hot")).alias("r"))
    asked = cut_lineage(detail.groupBy("i", "g").agg(F.collect_list("r").alias("runs")))
    same = lambda: plain["id"].eqNullSafe(F.col("i")) & (plain["sig"] == F.col("g"))
    # These joins and the last one read the same exchange of the texts, which Spark reuses within one plan: sig is never null, so that no join filters it.
    found = plain.join(asked, same()).select(F.col("text").cast("binary").alias("text"), "runs")
    some = not buckets.where(F.col("m") > split).isEmpty()

    def parts(hot: bool) -> DataFrame:
        own = F.filter("runs", lambda r: r["hot"] == hot) if some else F.col("runs")
        return found.select("text", own.alias("runs")).where(F.size("runs") > 0)

    repeated = parts(False).mapInArrow(_contexts, PART).repartition("a").sortWithinPartitions("a").mapInArrow(_intervals, "a bigint, s binary, f int, t int")
    if some:
        windows = parts(True).mapInArrow(_hot_windows, "h binary, a bigint, s binary, f int, many bigint")
        several = windows.groupBy(F.col("h").alias("w")).agg(F.sum("many").alias("m")).where("m > 1").select("w")
        repeated = repeated.unionByName(windows.join(several, F.col("h") == F.col("w")).select("a", "s", "f", (F.col("f") + WIDTH).alias("t")))
    repeated = repeated.select(F.col("a").alias("k"), F.col("s").alias("l"), "f", "t")
    lo = F.shiftright("pos", 16)
    gone = met.join(repeated, (F.col("a") == F.col("k")) & (F.col("s") == F.col("l"))).select("id", "sig", F.struct((lo + F.col("f")).cast("int").alias("s"), (lo + F.col("t")).cast("int").alias("e")).alias("cut"))
    gone = gone.groupBy(F.col("id").alias("i"), F.col("sig").alias("g")).agg(F.collect_set("cut").alias("cuts"))
    full = plain.join(gone, same(), "left").select("id", F.col("text").cast("binary").alias("text"), "cuts")
    out = full.mapInArrow(_cut, f"id {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def digest(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from remove_repeats()'s rows."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return cut.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
