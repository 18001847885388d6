import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import components, jaccard, suffixdedup


def docs_of(spark, texts, ids=None):
    rows = [(i, t, 5, "k", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int, key string, s int").repartition(3)


def edited(base, *at):
    words = base.split()
    for i in at:
        words[i] = f"edit{i}"
    return " ".join(words)


BASE = " ".join(f"w{(i * i) % 211}" for i in range(120))
NEAR = [BASE, edited(BASE, 60), edited(BASE, 10), edited(BASE, 10, 60), edited(BASE, 5, 30, 60, 90), edited(BASE, 5, 30, 60, 90, 110, 15), BASE.upper(), BASE, BASE + " " + BASE, "W1 w2", "w1  w2", "w2 w1"]


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


def test_jaccard_matches_all_pairs(spark, real):
    texts = brute.EDGE_TEXTS + NEAR + [t for _, t in real]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute.op9(texts)))
    assert jaccard.jaccard_components(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_jaccard_repeated_and_null_ids(spark):
    df = docs_of(spark, [BASE, "other words that have nothing in common at all", BASE, None, BASE], [7, 7, 3, None, None])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df).collect())
    n = brute.op9([BASE])[0][0]
    assert got == [("3", n, "None"), ("7", 5, "7"), ("7", n, "None"), ("None", 0, "None"), ("None", n, "None")]


def test_jaccard_links_found_by_the_full_round_alone(spark, real):
    texts = NEAR + [t for _, t in real]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts), star_rounds=0, nearest_rounds=0).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute.op9(texts))}


def test_jaccard_nearest_rounds(spark, real):
    texts = NEAR + [t for _, t in real]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts), star_rounds=0, nearest_rounds=3).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute.op9(texts))}


def test_one_of_each_stays(spark):
    out = jaccard.keep_one_of_each(docs_of(spark, NEAR + [None, ""]))
    want = {c for _, c in brute.op9(NEAR + [None, ""])}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want) and out.columns == ["doc_id", "text", "n", "key", "s"]


def test_signature_tree_keeps_every_possible_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, int(rng.integers(3, 200)), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(0, 1 << 63, len(base), dtype=np.uint64), base))]
    n, maps = np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets]
    found = {tuple(sorted(p)) for i, j, _ in jaccard.block_pairs(n, maps, np.arange(len(sets))) for p in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert (a, b) in found or 100 * both < 75 * (len(sets[a]) + len(sets[b]) - both)
    assert len(found) < 300  # of 7140 pairs


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 70), (70, 60), (5, 5), (9, 8)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 50 for i in (50, 60, 70, 100)}}


PASSAGE = " ".join(f"p{i * 37 % 101}" for i in range(70))
REPEATS = [
    "start " + PASSAGE + " end", "another start, " + PASSAGE + " and another end", PASSAGE[:199], PASSAGE[:200], PASSAGE[20:221], "é" * 150, "ab" * 300, "x" * 199, "x" * 200, "x" * 201,
    "x" * 500 + PASSAGE, "y" + PASSAGE[:210] + "z", PASSAGE[5:215] + PASSAGE[5:215], "\x00" * 250, "\x00" * 250, "漢字テキスト" * 50,
]


@pytest.mark.parametrize("split", [suffixdedup.SPLIT, 1])
def test_suffix_dedup_matches_brute_force(spark, real, split):
    texts = brute.EDGE_TEXTS + REPEATS + [t for _, t in real]
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.digest(suffixdedup.remove_repeats(docs_of(spark, texts), split=split)).collect()}
    assert got == dict(enumerate(brute.op5(texts)))


def test_suffix_dedup_repeated_and_null_ids(spark):
    texts, ids = [PASSAGE, PASSAGE + "x", PASSAGE[:150] + "q" * 100, None, "tail" + PASSAGE], [1, 1, 1, None, None]
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in suffixdedup.digest(suffixdedup.remove_repeats(docs_of(spark, texts, ids))).collect())
    assert got == sorted((str(i), *w) for i, w in zip(ids, brute.op5(texts), strict=True))
    assert suffixdedup.remove_repeats(docs_of(spark, texts, ids).limit(0)).count() == 0


def test_suffix_sort_orders_and_extends():
    rng = np.random.default_rng(5)
    for alphabet in (1, 2, 30):
        data = rng.integers(0, alphabet, 3000).astype(np.uint8)
        sizes = np.array([1, 2, 57, 3, 200, 1])
        start = rng.integers(0, 2900, sizes.sum())
        length = rng.integers(0, 100, sizes.sum())
        order, shared = suffixdedup.sort_suffixes(data, start, length, sizes)
        plain, extent = suffixdedup._sort_plainly(data, start, length, sizes)
        text = [data[s : s + n].tobytes() for s, n in zip(start, length, strict=True)]
        assert [text[i] for i in order] == [text[i] for i in plain] and shared.tolist() == extent.tolist()


def thue_morse(order, swap=False):
    out = "ab"[swap]
    for _ in range(order):
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_jaccard_words_that_collide_in_polynomial_hashes_are_told_apart(spark):
    texts = [f"one two three four {thue_morse(10)}", f"one two three four {thue_morse(10, True)}", thue_morse(12), thue_morse(12, True)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == {i: i for i in range(4)}


def test_jaccard_counts_the_words_when_hashes_collide(monkeypatch):
    import zlib

    pack = lambda t: zlib.compress(t.encode())
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    monkeypatch.setattr(jaccard, "_shingles", lambda h, gram, own: np.arange(len(h) - gram + 1, dtype=np.uint64))
    assert jaccard.Shingled(pack(one)).linked(jaccard.Shingled(pack(one))) and not jaccard.Shingled(pack(one)).linked(jaccard.Shingled(pack(two)))


def test_jaccard_tiles_hold_every_pair_that_a_block_holds(spark, monkeypatch, real):
    monkeypatch.setattr(jaccard, "TILE", 3)
    texts = NEAR + [edited(BASE, i) for i in range(40)] + [edited(BASE, i, i + 3, i + 7, i + 20, i + 40, i + 70) for i in range(40)] + [t for _, t in real[:60]]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts), star_rounds=0, nearest_rounds=1).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute.op9(texts))}


def test_links_of_a_leader_come_from_the_traversal_of_its_members_tree(monkeypatch):
    import pyarrow as pa

    texts = [BASE, *(edited(BASE, i) for i in range(0, 100, 9)), *(" ".join(f"{c}{i}" for i in range(120)) for c in "abcdef")]
    (packed,) = jaccard._pack(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])]))
    node = packed.column("node")
    names = ["a", "salt", "role", "node", "n", "bits", "z"]
    rows = pa.RecordBatch.from_arrays([node.take(pa.array([0] * len(texts))), pa.array([0] * len(texts)), pa.array([0] + [1] * (len(texts) - 1)), node, *(packed.column(c) for c in names[4:])], names=names)
    linked = lambda: sorted(i["id"] for b in jaccard._compare(iter([rows])) for i in b.column("u").to_pylist())
    wanted = [i for i, (_, c) in enumerate(brute.op9(texts)) if i and c == 0]
    assert linked() == wanted and len(wanted) == 12
    met, plain = [], jaccard.dual_traversal
    monkeypatch.setattr(jaccard, "dual_traversal", lambda x, y: (met.append(p) or p for p in plain(x, y)))
    assert linked() == wanted and sum(len(i) for i, _, _ in met) == 12  # unlike members are pruned by their signatures
    monkeypatch.setattr(jaccard, "dual_traversal", lambda x, y: iter(()))
    assert linked() == []


def test_block_of_unlike_documents_is_dealt_out(spark):
    rows = [(1, 20_000, i, i, 50 + i % 400) for i in range(20_000)]
    dealt = jaccard._tiled(spark.createDataFrame(rows, "key long, m long, node long, part long, n long").withColumn("bits", F.lit(b"")))
    most = dealt.groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= 2 * jaccard.TILE and dealt.count() <= 3 * 5 * 20_000


def test_every_repeat_comes_from_the_suffix_sort(monkeypatch):
    """Kinds that occur twice are found repeated by the sort alone, with their bytes verified."""
    import pyarrow as pa

    raw = [PASSAGE[:260].encode(), PASSAGE[10:270].encode(), b"q" * 100 + PASSAGE[:160].encode()]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array([b"x", b"y", b"z"]), pa.array([100, 90, 100], pa.int32()), pa.array([False, False, True]), pa.array(raw), pa.nulls(3, pa.int32()), pa.nulls(3, pa.int32())], names=["a", "s", "at", "twice", "bytes", "f", "t"])
    found = lambda: [(r["s"], r["f"], r["t"]) for b in suffixdedup._intervals(iter([rows])) for r in b.to_pylist()]
    assert found() == [(b"x", 10, 260), (b"y", 0, 250), (b"z", 0, 260)]
    checked, plain = [], suffixdedup._verified
    monkeypatch.setattr(suffixdedup, "_verified", lambda *x: checked.append(plain(*x)) or checked[-1])
    found()
    assert checked == [True, True]
    monkeypatch.setattr(suffixdedup, "_extension", lambda c, inverse, i, j, cap: cap.copy())  # every comparison collides
    assert found() == [(b"x", 10, 260), (b"y", 0, 250), (b"z", 0, 260)]


def test_sort_blocks_hold_whole_buckets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixdedup, "BLOCK", 3)
    text = PASSAGE[:220].encode()
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5, 5, 6, 6]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([str(i).encode() for i in range(13)]), pa.array([100] * 13, pa.int32()), pa.array([k in (2, 4) for k in keys]), pa.array([text] * 13), pa.nulls(13, pa.int32()), pa.nulls(13, pa.int32())], names=["a", "s", "at", "twice", "bytes", "f", "t"])
    for cuts in ([13], [1, 12], [4, 4, 5], [2, 1, 4, 6], [1] * 13):
        at, parts = 0, []
        for n in cuts:
            parts.append(rows.slice(at, n))
            at += n
        out = list(suffixdedup._intervals(iter(parts)))
        assert sorted(int(r["s"]) for b in out for r in b.to_pylist()) == list(range(13)) and len(out) == 4


def test_suffix_dedup_keeps_rows_of_one_id_whose_short_hashes_agree(spark):
    """Two texts under a null id that 32 bits of xxhash64 can't tell apart: only the one with a copy loses bytes."""
    import xxhash

    one, two = ("".join(chr(97 + (i * i * k + i // 7) % 26) for i in range(260)) for k in (3, 11))
    short = {xxhash.xxh64(f"{one}{i}", seed=42).intdigest() & 0xFFFFFFFF: f"{one}{i}" for i in range(200_000)}
    a, b = next((short[h], f"{two}{i}") for i in range(400_000) if (h := xxhash.xxh64(f"{two}{i}", seed=42).intdigest() & 0xFFFFFFFF) in short)
    rows = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixdedup.digest(suffixdedup.remove_repeats(rows)).collect())
    assert got == sorted((n, gone, kept) for n, gone, _, kept in brute.op5([a, a, b]))
    assert sorted(g[1] for g in got)[0] == 0


def test_suffix_dedup_holds_little_and_one_worker_a_task(spark, real, monkeypatch):
    """Each Python step of a stage holds a worker of its own, and each slice about a hundred times its bytes."""
    import re
    import tracemalloc

    import pyarrow as pa

    plans, cut = [], suffixdedup.cut_lineage
    monkeypatch.setattr(suffixdedup, "cut_lineage", lambda df: plans.append(df) or cut(df))
    plans.append(suffixdedup.remove_repeats(docs_of(spark, [t for _, t in real]), split=1))
    shown = [p._jdf.queryExecution().sparkPlan().toString() for p in plans]
    steps = [re.sub(r"^[\s:+*|-]*(?:\(\d+\) )?", "", line).split("(")[0].split(" ")[0] for p in shown for line in p.splitlines()]
    assert "MapInArrow" in steps and not re.search(r"MapInArrow( Project| Filter)* MapInArrow", " ".join(steps))
    texts = pa.RecordBatch.from_arrays([pa.array(["".join(chr(97 + (i * i * k) % 23) for i in range(20_000)) for k in range(1, 101)])], names=["text"])
    tracemalloc.start()
    assert sum(b.num_rows for b in suffixdedup._anchors(iter([texts]))) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
