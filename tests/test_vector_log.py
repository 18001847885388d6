"""The vector store as a log: what is written, what a reader sees, who gets a version, what compaction keeps, what the lists find."""

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import ranking
from evidentia.sources.vectors import VectorTable

ROWS = "id string, text string, embedding array<float>, metadata map<string, string>"


def rows(spark, ids, text="t"):
    return spark.createDataFrame([(i, f"{text}{i}", [float(ord(i[-1]) % 7), 1.0], {"k": i}) for i in ids], ROWS)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def seen(table, version=None):
    return {r.id: r.text for r in table.read(version).collect()}


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_an_add_writes_what_it_adds(spark, tmp_path):
    path = tmp_path / "v"
    table = VectorTable(spark, str(path))
    rng = np.random.default_rng(5)
    many = spark.createDataFrame([(f"r{i}", "text", rng.normal(size=64).tolist(), {"n": str(i)}) for i in range(3000)], ROWS)
    table.add(many)
    before = size(path)
    table.add(rows(spark, ["a", "b", "c"]))
    assert size(path) - before < before / 20
    before = size(path)
    table.delete(ids(spark, "r1", "r2", "zz"))
    assert size(path) - before < before / 20
    assert table.count() == 3001


def test_newest_rows_and_tombstones(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "v"))
    assert seen(table) == {} and table.count() == 0
    one = table.add(rows(spark, ["a", "b", "c"]))
    two = table.add(rows(spark, ["a"], "new "))
    three = table.delete(ids(spark, "b"))
    four = table.add(rows(spark, ["b"], "again "))
    assert one < two < three < four
    assert seen(table) == {"a": "new a", "b": "again b", "c": "tc"}
    assert seen(table, one) == {"a": "ta", "b": "tb", "c": "tc"} and seen(table, three) == {"a": "new a", "c": "tc"}
    extra = rows(spark, ["a", "a"]).withColumn("version", F.lit(9)).withColumn("id", F.when(F.rand(1) < 2, F.lit(None).cast("string")))
    table.add(extra)  # no id: named by the contents; columns of the same names as the log's are ignored
    assert table.count() == 4
    table.delete(table.read().select("id"))
    assert table.count() == 0
    table.add(rows(spark, []))
    table.add(spark.createDataFrame([("n", None, None, None)], ROWS))
    assert seen(table) == {"n": None}


def test_compaction_keeps_every_version_until_vacuum(spark, tmp_path):
    path = tmp_path / "v"
    table = VectorTable(spark, str(path))
    table.add(rows(spark, list("abcdefgh")))
    for i in "xyz":
        table.add(rows(spark, [i, "a"], f"by {i} "))
    table.delete(ids(spark, "b", "x"))
    last = max(r["version"] for r in table.records())
    want = seen(table)
    assert want == {**{i: f"t{i}" for i in "cdefgh"}, "a": "by z a", "y": "by y y", "z": "by z z"}
    table.compact()
    assert len(table.records()) == 2 and seen(table) == want and seen(table, last) == want
    table.add(rows(spark, ["b"], "back "))
    table.compact(full=True)
    assert len(table.records()) == 1 and seen(table) == {**want, "b": "back b"} and seen(table, last) == want
    assert table.vacuum() and seen(table) == {**want, "b": "back b"}
    assert len([p for p in path.iterdir() if p.name != "_log"]) == 1
    assert table.compact() is None and table.add(rows(spark, ["q"])) > last


def test_half_a_write_is_never_seen(spark, tmp_path, monkeypatch):
    path = tmp_path / "v"
    table = VectorTable(spark, str(path))
    table.add(rows(spark, ["a"]))
    with monkeypatch.context() as m:
        m.setattr(VectorTable, "_publish", lambda self, record: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.add(rows(spark, ["b"]))
    (path / "_log" / "draft-1").write_text(json.dumps({"version": 2})[:5])
    assert seen(table) == {"a": "ta"}
    table.add(rows(spark, ["c"]))
    assert set(seen(table)) == {"a", "c"}
    with monkeypatch.context() as m:  # a listing that fails is no empty store
        m.setattr(VectorTable, "_names", lambda self: (_ for _ in ()).throw(OSError("no listing")))
        with pytest.raises(OSError):
            table.read()
        with pytest.raises(OSError):
            table.add(rows(spark, ["d"]))
    assert set(seen(table)) == {"a", "c"}


def test_writers_at_the_same_time_get_versions_of_their_own(spark, tmp_path):
    path = str(tmp_path / "v")
    with ThreadPoolExecutor(8) as pool:
        claimed = list(pool.map(lambda _: VectorTable(spark, path)._claim(), range(40)))
    assert sorted(claimed) == list(range(1, 41))
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: VectorTable(spark, path).add(rows(spark, [f"w{i}"])), range(6)))
    assert len(set(made)) == 6 and set(seen(VectorTable(spark, path))) == {f"w{i}" for i in range(6)}


def test_records_count_in_whatever_order_they_are_published(spark, tmp_path, monkeypatch):
    table, held = VectorTable(spark, str(tmp_path / "v")), []
    table.add(rows(spark, ["a", "b"], "first "))
    publish = VectorTable._publish
    with monkeypatch.context() as m:
        m.setattr(VectorTable, "_publish", lambda self, record: held.append(record) or record["version"])
        table.add(rows(spark, ["a", "c"], "slow "))
    table.add(rows(spark, ["a"], "newest "))
    table.compact(full=True)
    publish(table, held[0])
    assert seen(table) == {"a": "newest a", "b": "first b", "c": "slow c"}
    with pytest.raises(RuntimeError):
        table._create("_log/compacting")
        table.compact()


def test_lists_find_added_rows_without_a_rebuild(spark, sf_dir, tmp_path):
    table = VectorTable(spark, str(tmp_path / "v"))
    vectors = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet")
    stored = vectors.select(F.col("vec_id").cast("string").alias("id"), F.lit("").alias("text"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    late = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    table.add(stored.where(~late))
    assert 1 < table.index(8) == table.probes() <= 8
    table.add(stored.where(late))
    assert all(r.list is not None for r in table._all().collect())
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    full = {(r.query_id, r.id) for r in table.search(asked, 10).collect()}
    some = {(r.query_id, r.id) for r in table.search(asked, 10, approximate=True).collect()}
    assert len(some) == len(full) and len(full & some) >= 0.9 * len(full)
    assert any(int(i) for q, i in some & full if int(i) in {int(r.id) for r in stored.where(late).select("id").collect()})
    assert full == {(r.query_id, r.id) for r in table.search(asked, 10, approximate=True, probes=8).collect()}
    only = table.search(asked, 3, where={"label": "3"}, approximate=True).join(stored.selectExpr("id", "metadata['label'] as label"), "id")
    assert {r.label for r in only.collect()} == {"3"}
    # rows from before there were lists are searched for every query
    bare = VectorTable(spark, str(tmp_path / "w"))
    bare.add(stored)
    assert bare.search(asked, 10, approximate=True).count() == len(full)
    unlisted = ranking.nearest_by_lists(asked, stored.withColumn("list", F.lit(None).cast("int")), 10, table.centres(), probes=1, vector_id="id", vector_list="list")
    assert {(r.query_id, r.id) for r in unlisted.collect()} == full


def test_lists_of_grouped_vectors_need_few_probes(spark, tmp_path):
    table, rng = VectorTable(spark, str(tmp_path / "v")), np.random.default_rng(2)
    middle = rng.normal(size=(12, 16))
    made = [(f"r{i}", "", (middle[i % 12] + 0.2 * rng.normal(size=16)).tolist(), {}) for i in range(1200)]
    table.add(spark.createDataFrame(made, ROWS))
    assert table.index(12) <= 4
    assert VectorTable(spark, str(tmp_path / "w")).index(4) >= 1  # an empty store
