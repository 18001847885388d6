"""Filter audit, WARC archives and ball-tree clusters against plain versions, and at their edges."""

import gzip
import hashlib
import json
import math
import re
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import audit, balltree, warc

# --- filter audit ---------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """rows by (part, order, step) by the definition: every order applied to every document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    flags = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        flags.append((source or "", i, fails))
    out = {}
    for part in {f[0] for f in flags}:
        own, total = [f for f in flags if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if x[2][f]]
                left = [x for x in left if not x[2][f]]
                total[f] += len(gone)
                out[part, "".join(order), k] = [
                    len(left), len(gone), sum(x[2][f] for x in own) - len(gone), sum(x[2][f] and sum(x[2].values()) == 1 for x in own),
                    sum(x[1] in good for x in gone if x[1] is not None), sum(x[1] in toxic for x in gone if x[1] is not None), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, source string, part string, A int")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = audit.audit_filters(df, lab).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_matches_brute_force(spark, sf_dir):
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:60]
    long = " ".join(f"w{i}" for i in range(260))
    docs = real + [(1000 + i, t, (None, "", "edge")[i % 3]) for i, t in enumerate(brute.EDGE_TEXTS)]
    docs += [(None, long, "edge"), (None, long, "edge"), (2000, long, "other"), (2001, long, "edge"), (2001, long, None), (-5, long + " A#", "edge"), (3000, None, "edge"), (3001, "", "edge")]
    labels = [(1000 + i, i % 2, (i + 1) % 2) for i in range(8)] + [(2001, 0, 1), (2001, 1, 0), (None, 1, 1), (-5, None, None)] + [(r[0], 1, 0) for r in real[:20]]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_nothing_is_empty(spark):
    assert audited(spark, [], []) == {}


def test_states_are_visited_once_and_survivors_shared(spark, monkeypatch):
    """31 sets with edges for 120 orders, and never more DataFrames persisted than filters."""
    names = list("ABCDE")
    rows = spark.range(64).select(F.lit("p").alias("part"), *[(F.shiftright("id", i) % 2 == 1).alias(n) for i, n in enumerate(names)], F.lit(True).alias("good"))
    frame, held, most, made = type(rows), [0], [0], [0]
    persist, release = frame.persist, frame.unpersist

    def counted(self, *a, **k):
        held[0], made[0] = held[0] + 1, made[0] + 1
        most[0] = max(most[0], held[0])
        return persist(self, *a, **k)

    def freed(self, *a, **k):
        held[0] -= 1
        return release(self, *a, **k)

    monkeypatch.setattr(frame, "persist", counted)
    monkeypatch.setattr(frame, "unpersist", freed)
    found = audit.edges(rows, names, marks=["good"])
    assert made[0] == 31 and most[0] <= 5 and held[0] == 0
    got = {(r.state, r["filter"]): r for r in found.collect()}
    for state in range(31):
        for i in range(5):
            if not state >> i & 1:
                assert got[state, i].held == 64 >> state.bit_count() and got[state, i].removed == got[state, i].held // 2 == got[state, i].good_lost
    with pytest.raises(ValueError):
        audit.edges(rows, list("ABCDEFGH"), marks=[])


# --- WARC ----------------------------------------------------------------------------------------------------

BIG = "<p>" + "same payload " * 20
PAGES = [
    (5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (4, "http://a/4\r\nX: y %41 é", "<b>" + "é漢" * 60), (1, "", None), (2, "http://a/2", ""), (7, "http://a/7", "short"), (8, "http://a/8", "short"),
    (10, "http://a/10", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 9), (11, "http://a/11", "x" * 300_000), (12, "http://a/12", "x" * 300_000), (13, "http://a/13", "y" * 99), (14, "http://a/14", "y" * 99),
    (15, "u", "z" * 100), (16, "u", "z" * 100), (3, "http://again/3", BIG), (3, "http://a/3", BIG), (None, "n", BIG), (None, "n", "n" * 200), (None, "m", "n" * 200), (-2, "neg", "\x00\x1f" * 80),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], "page_id bigint, url string, html string, digest string, kind int")


def plain_warc(rows):
    first = {}
    for i, _, html in rows:
        h = html or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, url, html in rows:
        h = html or ""
        revisit = h in first and (i is None or i > first[h])
        out.append((i, url, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else h.encode()))
    return sorted(out, key=repr)


def read(spark, path):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(spark, path).collect()), key=repr)


def names(path):
    return [x["name"] for x in json.loads((Path(path) / warc.MANIFEST).read_text())["files"]]


@pytest.mark.parametrize(("shard_bytes", "roll"), [(1 << 30, 1 << 30), (100_000, 1 << 30), (500, 700)])
def test_archives_round_trip(spark, tmp_path, shard_bytes, roll):
    path = str(tmp_path / "w")
    warc.write_archives(pages_of(spark, PAGES), path, shard_bytes=shard_bytes, roll_bytes=roll)
    assert read(spark, path) == plain_warc(PAGES)
    assert sorted(p.name for p in Path(path).iterdir() if not p.name.startswith(".")) == sorted([warc.MANIFEST, *names(path)])
    rows = warc.read_archives(spark, path).collect()
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == len(rows) == len(PAGES)
    text = b"".join(gzip.decompress((Path(path) / n).read_bytes()) for n in names(path))
    refers = re.findall(rb"WARC-Refers-To: (\S+)\r\n", text)
    assert len(refers) == sum(r.record_type == "revisit" for r in rows)
    assert all(by_id[x.decode()].record_type == "response" and by_id[x.decode()].payload_bytes == len(BIG) or by_id[x.decode()].payload_bytes in (100, 300_000) for x in refers)
    # the archives one after the other are in the order of the ids
    ids = [int(x) for x in re.findall(rb"X-Page-ID: (-?\d+)\r\n", text)]
    assert ids == sorted(ids)
    if roll < 1000:
        assert len(names(path)) > 5 and all(re.fullmatch(r"records-\d{6}-\d{4}\.warc\.gz", n) for n in names(path))


def test_archives_are_the_same_bytes_in_every_run(spark, tmp_path):
    one, two = str(tmp_path / "1"), str(tmp_path / "2")
    warc.write_archives(pages_of(spark, PAGES).repartition(1), one, shard_bytes=300, roll_bytes=2000)
    warc.write_archives(pages_of(spark, PAGES[::-1]).repartition(5), two, shard_bytes=300, roll_bytes=2000)
    assert names(one) == names(two) and len({n[:14] for n in names(one)}) > 2
    assert all((Path(one) / n).read_bytes() == (Path(two) / n).read_bytes() for n in [*names(one), warc.MANIFEST])


def test_a_failed_or_broken_write_shows_nothing(spark, tmp_path, monkeypatch):
    path = tmp_path / "w"
    bad = pages_of(spark, PAGES).withColumn("html", F.when(F.col("page_id") == 16, F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        warc.write_archives(bad, str(path))
    writer = warc.Writer({"path": str(path)})
    schema = spark.createDataFrame([], warc._IN).toArrow().schema
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"shard": 0, "page_id": 1, "digest": b"d", "kind": 1, "url": "u", "payload": b"p", "first": None}], schema=schema)
    lost, won = writer.write(iter([batch])), writer.write(iter([batch]))  # two attempts of one task: one reports
    assert lost.files[0][1] == won.files[0][1] and lost.files[0][0] != won.files[0][0]
    assert not (path / warc.MANIFEST).exists()
    with pytest.raises(FileNotFoundError):
        warc.Reader({"path": str(path)}).partitions()
    writer.commit([won])
    assert [p.name for p in path.iterdir()].count(names(path)[0]) == 1 and not (path / writer.job).exists()
    assert warc.read_archives(spark, str(path)).count() == 1
    with pytest.raises(FileExistsError):
        warc.write_archives(pages_of(spark, PAGES), str(path))
    other = warc.Writer({"path": str(tmp_path / "x")})
    other.write(iter([batch]))
    other.abort([None])
    assert not list((tmp_path / "x").iterdir())


def test_damage_is_found_and_nothing_written_is_an_empty_archive(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archives(pages_of(spark, PAGES[:6]), str(path))
    name = path / names(path)[0]
    text = gzip.decompress(name.read_bytes())
    name.write_bytes(gzip.compress(text.replace(b"same payload", b"sama payload", 1)))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, str(path)).collect()
    name.write_bytes(gzip.compress(text[: text.rindex(b"WARC/1.1")]))
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(spark, str(path)).collect()
    warc.write_archives(pages_of(spark, []), str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")) == []


def test_shards_are_even_and_follow_from_the_rows(spark):
    sizes = spark.range(5000).select(F.col("id").alias("page_id"), (F.when(F.col("id") < 100, 5000).otherwise(100)).cast("long").alias("n"))
    bounds = warc.shard_bounds(sizes, 100_000)
    assert bounds == warc.shard_bounds(sizes.repartition(7), 100_000) == sorted(set(bounds)) and len(bounds) == 9
    weight = [sum(5000 if i < 100 else 100 for i in range(a, b)) for a, b in zip([0, *bounds], [*bounds, 5000], strict=True)]
    assert max(weight) < 2.5 * min(weight)
    assert warc.shard_bounds(sizes.where("page_id < 0"), 100) == []


# --- ball trees --------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    order += [("~", v) for v in sorted(v for i, v in kept if i is None)]
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centres)]
    got = [(i, *nearest(v)) for i, v in kept]
    own = Counter()
    for _, d, j in got:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in got), key=repr)


def vectors(kind):
    rng = np.random.default_rng(4)
    if kind == "ties":
        rows = [(i, [float(i % 3), *([0.0] * 63)]) for i in range(30)] + [(i, [1.5, *([0.0] * 63)]) for i in range(30, 40)]
    elif kind == "grouped":
        rows = [(i, (rng.normal(size=64) * 0.01 + 3 * (i % 5)).tolist()) for i in range(300)]
    else:
        rows = [(i, (rng.normal(size=64) * (1 + i % 7)).tolist()) for i in range(150)] + [(500 + i, [0.25] * 64) for i in range(80)]
        rows += [(7, [0.5] * 64), (7, [0.5] * 64), (None, [0.5] * 64), (None, [1.0] * 64)]
        rows += [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None, *([1.0] * 63)]), (904, [math.nan, *([1.0] * 63)]), (905, [math.inf, *([1.0] * 63)]), (906, []), (907, [-1e5, *([1e5] * 63)])]
    return rows


@pytest.mark.parametrize("kind", ["ties", "grouped", "edges"])
@pytest.mark.parametrize("tree", [balltree.TREE, 20])
def test_clusters_match_brute_force(spark, kind, tree, monkeypatch):
    monkeypatch.setattr(balltree, "TREE", tree)
    monkeypatch.setattr(balltree, "LEAF", 4)
    rows = vectors(kind)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, 3, "c") for r in rows], "vec_id bigint, embedding array<float>, label int, cluster string").repartition(3)
    got = sorted((tuple(r) for r in balltree.cluster(df, k=7, rounds=3).collect()), key=repr)
    assert got == plain_clusters(rows, 7, 3)


def test_whole_balls_carry_most_of_grouped_vectors_and_copies(spark):
    rows = vectors("grouped") + [(1000 + i, [20.0] * 64) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    kept = balltree.kept_vectors(df)
    forest = balltree.trees(kept, 64)
    centres = np.array([[768 * j] * 64 for j in range(5)] + [[5120] * 64])
    _, how = balltree.assign_round(forest, centres, 64)
    assert how["whole"] + how["leaf"] == 500 and how["whole"] >= 450


def test_clusters_of_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert balltree.cluster(empty).count() == 0 and len(balltree.cluster(empty).columns) == 6
    two = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r)[2:5] for r in balltree.cluster(two).collect()) == [(0, 0, 0), (0, 0, 0)]
    with pytest.raises(Exception, match="exceeds"):
        balltree.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id bigint, embedding array<float>"))
