"""Cluster plumbing shared by the training-data operators.

* ``ship`` sends this package to the executors once per SparkContext, so Arrow functions that are
  pickled by reference import on machines that share no local folder with the driver.
* ``Scratch`` writes intermediate tables to the folder named by ``spark.checkpoint.dir`` (which all
  machines share) and reads them back.  This cuts lineage, and it survives the loss of an executor
  because nothing is kept on one machine only.
* ``connected_components`` labels graph nodes with the smallest node id they can reach.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LEFT: list[tuple[SparkSession, str]] = []

#: Rows of 64-bit keys that may be broadcast: 2 million ids are about 16 MB on the wire.
BROADCAST_ROWS = 2_000_000


#: Bytes and rows of one Arrow batch between the JVM and Python.  Texts are long, so Spark's own row
#: limit would make batches of tens of megabytes in each of an executor's workers.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor (once per application).

    Where the session leaves Spark's limits of Arrow batches as they are, they are set to smaller
    ones, and stay so (README says this): results are lazy, so they can't be put back here.
    """
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES),
    ):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    path = os.path.join(tempfile.mkdtemp(prefix="stemquarry"), "stemquarry_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "stemquarry").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Where the session names none, a local session (tests) gets a
    folder of its own; on a cluster that folder would be a different one on each machine: an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stemquarry-checkpoint")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark can write to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named intermediate tables of one operator call, in the shared folder."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"
        self.n = 0
        _LEFT.append((spark, self.base))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # plain attribute for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that later steps no longer read."""
        for t in tables:
            remove(self.spark, t.scratch_path)


@atexit.register
def release() -> None:
    """Delete the intermediate tables of all results made so far.  Long sessions call it once they
    have written their results; the end of the application does it anyway."""
    while _LEFT:
        spark, base = _LEFT.pop()
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, base)
        except Exception:  # noqa: BLE001  the application has ended; nothing to report to
            return


def only_ids(df: DataFrame, ids: DataFrame, n_ids: int, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``.

    The ids are broadcast only when their counted number is at most BROADCAST_ROWS; beyond that
    the semi join shuffles both sides.
    """
    if n_ids <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def except_ids(df: DataFrame, ids: DataFrame, n_ids: int, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids`` (null keys stay), under the same bound."""
    if n_ids <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_anti").select(df.columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def connected_components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Label nodes of ``edges(a long, b long)`` with the smallest reachable node id.

    Each round gives every node its smallest neighbour (or itself) as a parent, takes the parent's
    parent, and contracts the graph to parents that still have an edge between them, so edges shrink
    from round to round and stars vanish in one; the rounds' parents are put together at the end.
    Parents are aggregated map-side before the shuffle.  The joins whose keys can be hot (the edges of
    a hub, the children of a parent) read written tables on both sides and have one row for each key
    on the other side, so Spark splits their large partitions; lineage is cut by those tables.
    Returns (node, component) for every node that has an edge; an empty edge list gives an empty table.
    """
    both_ways = lambda e: e.where("a <> b").union(e.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    graph = scratch.save(both_ways(edges.select("a", "b")), "cc-edges")
    rounds: list[DataFrame] = []
    while True:
        nearest = scratch.save(graph.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")), "cc-nearest")
        up = nearest.select("parent").distinct().join(nearest.select(F.col("node").alias("parent"), F.col("parent").alias("up")), "parent")
        up = scratch.save(up, "cc-up")
        parents = scratch.save(nearest.join(up, "parent").select("node", F.col("up").alias("parent")), "cc-parents")
        rounds.append(parents)
        moved = graph.where("a < b").join(parents.select(F.col("node").alias("a"), F.col("parent").alias("of_a")), "a")
        moved = moved.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("of_b")), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        left = scratch.save(both_ways(moved), "cc-edges")
        scratch.drop(nearest, up, graph)
        graph = left
        if not graph.limit(1).count():
            break
    labels = rounds.pop()
    while rounds:
        below = rounds.pop()
        merged = below.join(labels.select(F.col("node").alias("parent"), F.col("parent").alias("top")), "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
        merged = scratch.save(merged, "cc-labels")
        scratch.drop(below, labels)
        labels = merged
    scratch.drop(graph)
    return labels.select("node", F.col("parent").alias("component"))
