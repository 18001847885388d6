"""A vector store as a log: adding and deleting write a folder of what they are given and one record, nothing else.

A writer claims the next version number, writes its rows or tombstones below a folder of that name, and
then publishes a record by renaming it into the log. Readers list the log: a folder without a record is
no part of any version, so that half a write is never seen. Every row carries the version that wrote it;
the newest row of an id counts unless a newer tombstone names it. The result follows from the set of
records, in whatever order they were published.

Compaction folds records into one that names them. Folding the smaller ones beside the largest keeps the
work for n added rows at n log n bytes; a full compaction drops what was replaced or deleted. Folded
folders stay readable by version until vacuum().
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking
from ..schemas import VECTOR

ROWS = f"{VECTOR}, version bigint, list int"
GONE = "id string, version bigint"
LOG, LOCK = "_log", "compacting"


class VectorTable:
    """Rows of (id, text, embedding, metadata). Adding an id again replaces its row.

    A row without an id gets one from its contents. Of rows of one add that share an id one stays, by a hash of the
    contents. Embeddings may be null; such rows are stored and never found by search(). The path is a file system
    that driver and executors share; claims need an exclusive create, as local disks and HDFS offer it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"

    # --- the log ---

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _create(self, name: str) -> bool:
        """Whether this call made the file, and no other one did before."""
        at = self._at(name)
        self._fs.mkdirs(at.getParent())
        if self._local:
            return self._jvm.java.io.File(at.toUri().getPath()).createNewFile()
        try:
            self._fs.create(at, False).close()
            return True
        except Exception:
            if self._fs.exists(at):
                return False
            raise

    def _names(self) -> list[str]:
        """The names in the log; none if there is no log. Any other failure is the caller's."""
        at = self._at(LOG)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _claim(self) -> int:
        """A version number that no other writer has or gets."""
        taken = [int(n.split(".")[0]) for n in self._names() if n[0].isdigit()]
        version = max(taken, default=0) + 1
        while not self._create(f"{LOG}/{version:012d}.claim"):
            version += 1
        return version

    def _publish(self, record: dict) -> int:
        """The record of a claimed version, complete or not there."""
        draft = self._at(f"{LOG}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if not self._fs.rename(draft, self._at(f"{LOG}/{record['version']:012d}.json")):
            raise OSError(f"version {record['version']} could not be published")
        return record["version"]

    def records(self, version: int | None = None) -> list[dict]:
        """The records that make up a version (the newest by default): all up to it but those that one of them folds."""
        out = []
        for name in sorted(n for n in self._names() if n.endswith(".json")):
            if version is None or int(name[:12]) <= version:
                stream = self._fs.open(self._at(f"{LOG}/{name}"))
                try:
                    out.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        folded = {v for r in out for v in r.get("folds", [])}
        return [r for r in out if r["version"] not in folded]

    # --- writing ---

    def add(self, rows: DataFrame) -> int:
        """The version that holds rows (id, text, embedding, metadata) beside what was there. Writes these rows alone."""
        centres = self.centres()
        own = F.struct("text", "embedding", "metadata")
        named = rows.select(F.coalesce(F.col("id"), F.md5(F.to_json(F.struct("text", "embedding")))).alias("id"), own.alias("r"))
        fresh = named.groupBy("id").agg(F.max_by("r", F.xxhash64(F.to_json("r"))).alias("r")).select("id", "r.*")
        version = self._claim()
        fresh = fresh.selectExpr("id", "text", "cast(embedding as array<float>) embedding", "metadata").withColumn("version", F.lit(version).cast("long"))
        return self._publish({"version": version, "lo": version, "hi": version, "rows": self._write(self._listed(fresh, centres), f"{version:012d}/rows"), "gone": 0})

    def delete(self, ids: DataFrame) -> int:
        """The version without the rows of ids (id). Writes the ids alone."""
        version = self._claim()
        gone = self._write(ids.select(F.col("id").cast("string").alias("id")).distinct().withColumn("version", F.lit(version).cast("long")), f"{version:012d}/gone")
        return self._publish({"version": version, "lo": version, "hi": version, "rows": 0, "gone": gone})

    def _write(self, df: DataFrame, name: str) -> int:
        """How many rows were written, counted on the way."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{name}")
        return seen.get["n"]

    # --- reading ---

    def _part(self, records: list[dict], kind: str) -> DataFrame:
        names = [f"{self.path}/{r['version']:012d}/{kind}" for r in records if r[kind]]
        schema = ROWS if kind == "rows" else GONE
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _resolved(self, records: list[dict]) -> DataFrame:
        """The newest row of each id, without those that a newer tombstone names.

        What can replace a row is the rows of the younger records and the tombstones, by id and version alone; if the
        oldest record is older than all others as a whole, its rows replace nothing and are not shuffled where the
        others are small enough to broadcast.
        """
        rows = self._part(records, "rows")
        first = min(records, key=lambda r: r["hi"], default=None)
        others = [r for r in records if r is not first]
        if all(first["hi"] < r["lo"] for r in others):
            younger = others
        else:
            younger = records
        if not younger and not any(r["gone"] for r in records):
            return rows
        newer = self._part(younger, "rows").select("id", "version").unionByName(self._part(records, "gone")).groupBy(F.col("id").alias("n")).agg(F.max("version").alias("v"))
        return rows.join(newer, (F.col("id") == F.col("n")) & (F.col("v") > F.col("version")), "left_anti")

    def _all(self, version: int | None = None) -> DataFrame:
        records = [r for r in self.records(version) if "rows" in r]
        return self._resolved(records) if records else self.spark.createDataFrame([], ROWS)

    def read(self, version: int | None = None) -> DataFrame:
        """(id, text, embedding, metadata) of a version, the newest by default."""
        return self._all(version).drop("version", "list")

    def count(self) -> int:
        return self.read().count()

    # --- upkeep ---

    def compact(self, *, full: bool = False) -> int | None:
        """Folds the records beside the largest one, or all, into one; None if there is nothing to fold. One compaction runs at a time."""
        if not self._create(f"{LOG}/{LOCK}"):
            raise RuntimeError(f"{self.path} is being compacted")
        try:
            records = [r for r in self.records() if "rows" in r]
            largest = max(records, key=lambda r: r["rows"], default=None)
            fold = records if full else [r for r in records if r is not largest]
            if len(fold) < 2 - full:
                return None
            centres, version = self.centres(), self._claim()
            rows = self._resolved(fold)
            rows = self._listed(rows.drop("list"), centres).repartitionByRange("list", "id").sortWithinPartitions("list", "id") if full else rows
            record = {"version": version, "lo": min(r["lo"] for r in fold), "hi": max(r["hi"] for r in fold), "folds": [r["version"] for r in fold], "rows": self._write(rows, f"{version:012d}/rows"), "gone": 0}
            if not full:
                record["gone"] = self._write(self._part(fold, "gone").groupBy("id").agg(F.max("version").alias("version")), f"{version:012d}/gone")
            return self._publish(record)
        finally:
            self._fs.delete(self._at(f"{LOG}/{LOCK}"), False)

    def vacuum(self) -> list[int]:
        """The folded versions, whose folders and records are removed: their readers must be done."""
        live = {r["version"] for r in self.records()}
        gone = [int(n[:12]) for n in self._names() if n.endswith(".json") and int(n[:12]) not in live]
        for v in gone:
            self._fs.delete(self._at(f"{v:012d}"), True)
            self._fs.delete(self._at(f"{LOG}/{v:012d}.json"), False)  # the claim stays: no number comes again
        return gone

    # --- search ---

    def centres(self) -> np.ndarray | None:
        """The centres of the lists, if index() has made some."""
        made = [r for r in self.records() if "centres" in r]
        if not made:
            return None
        rows = self.spark.read.parquet(f"{self.path}/{made[-1]['version']:012d}/centres").orderBy("list").collect()
        return np.array([r.centre for r in rows], dtype=np.float64)

    def _listed(self, rows: DataFrame, centres: np.ndarray | None) -> DataFrame:
        """rows with the list of the nearest centre; null without centres or an embedding of their length."""
        return rows.withColumn("list", F.lit(None).cast("int") if centres is None else F.get(ranking.nearest_lists(centres, 1)("embedding"), F.lit(0)))

    def index(self, lists: int, *, sample: int = 20_000, recall: float = 0.95, asked: int = 200) -> int:
        """Fits ``lists`` centres on at most ``sample`` vectors, deals all rows out to them and returns how many lists a search has to probe.

        That number is measured: the least one that holds ``recall`` of the ten exact neighbours of ``asked`` stored
        vectors. Rows added later find their list as they are written, so that no rebuild is needed.
        """
        made = ranking.centroids(self.read(), lists, vector_id="id", vector_vec="embedding", sample=sample)
        version = self._claim()
        self._write(self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(made)], "list int, centre array<double>"), f"{version:012d}/centres")
        self._publish({"version": version, "centres": len(made), "folds": [r["version"] for r in self.records() if "centres" in r or "probes" in r]})
        self.compact(full=True)
        rows = self._all().where("list is not null")
        some = rows.select(F.col("id").alias("query_id"), "embedding").orderBy(F.xxhash64("query_id")).limit(asked)
        near = ranking.nearest(some, rows, 10, vector_id="id")
        near = near.join(some, "query_id").join(rows.select("id", "list"), "id").select("embedding", "list").collect()  # ten rows a query asked
        probes = len(made)
        if near:
            order = np.argsort(-(np.array([r.embedding for r in near], dtype=np.float64) @ made.T), axis=1, kind="stable")
            place = np.sort((order == np.array([[r.list] for r in near])).argmax(axis=1))
            probes = int(place[int(np.ceil(recall * len(place))) - 1]) + 1
        self._publish({"version": self._claim(), "probes": probes})
        return probes

    def probes(self) -> int | None:
        """How many lists a search has to probe, as index() measured it."""
        return next((r["probes"] for r in reversed(self.records()) if "probes" in r), None)

    def search(self, queries: DataFrame, k: int, *, where: dict[str, str] | None = None, approximate: bool = False, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): exact, or from the nearest lists of each query and the rows that have none, if there is an index."""
        match = None
        for key, value in (where or {}).items():
            term = F.col("metadata")[key] == value
            match = term if match is None else match & term
        centres = self.centres() if approximate else None
        if centres is None:
            return ranking.nearest(queries, self.read(), k, vector_id="id", where=match)
        rows = self._all()
        return ranking.nearest_by_lists(queries, rows if match is None else rows.where(match), k, centres, probes=probes or self.probes() or len(centres), vector_id="id", vector_list="list")
