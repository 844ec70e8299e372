"""What the operators share: scratch tables, bounded Arrow batches, labels, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold, so that a batch of long texts fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 400, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit what reaches a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="proofmill-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables written once to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/proofmill/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str, partitionBy: str | None = None, **options: str) -> DataFrame:  # noqa: N803
        """Write df and return it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.options(**options).parquet(path, partitionBy=partitionBy)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps now; it does so when the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        self._delete(df._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete every table but these."""
        for path in set(self.paths) - {t._scratch_path for t in tables}:
            self._delete(path)

    def _delete(self, name: str) -> None:
        self.paths.remove(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this row are kept from training: crc32(doc_id as text) mod 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: A key is hot if it holds more than one in HOT of a table's rows, so there are at most so many of them and they may be broadcast, and HOT_ROWS at least.
HOT, HOT_ROWS = 1000, 10_000


def with_hot(side: DataFrame, *sizes: str) -> DataFrame:
    """side, a written table with one row for each key, and, if there are hot keys, the column hot: whether one of `sizes`, which count the key's rows, makes it so."""
    found = side.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in sizes), *(F.coalesce(F.max(c), F.lit(0)) for c in sizes)).first()
    least = [max(t / HOT, HOT_ROWS) for t in found[: len(sizes)]]
    if all(most <= limit for most, limit in zip(found[len(sizes) :], least, strict=True)):
        return side
    return side.withColumn("hot", reduce(or_, (F.coalesce(F.col(c) > limit, F.lit(False)) for c, limit in zip(sizes, least, strict=True))))


def join_unique(rows: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined (inner or left) with side, which has one row for each key: its hot keys, if it has any (with_hot), by broadcast, so that none is a hot task."""
    if "hot" not in side.columns:
        return rows.join(side, key, how)
    hot, rest = side.where("hot").drop("hot"), side.where("not hot").drop("hot")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how))


def hash_sample(df: DataFrame, keys: list[Column], sample: int, total: int) -> DataFrame:
    """At most `sample` of the `total` rows, those with the smallest hashes of their keys: the same whatever the partitions are.

    A threshold on the hash leaves little more than the sample before rows are ordered, so tasks send few of them.
    """
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    return df.where(h <= int((1 << 40) * min(1.0, (1.5 * sample + 64) / max(total, 1)))).orderBy(h, *keys).limit(sample)


def is_empty(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) == 0


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Label each node of edges (u, v long) with the smallest node that it reaches.

    Alternating large-star and small-star steps until every node but the smallest of its component has one edge, to that one: every step is a
    min per node (combined map-side) and an equi-join that adaptive execution may split where a node is hot. Returns (id, comp).
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()

    def settled(df: DataFrame) -> bool:
        """No node has two edges to smaller ones, and none that has one is the smaller end of another."""
        ends = df.select(F.col("a").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("b", F.lit(0), F.lit(1)))
        per = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not per.agg(F.max(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()[0]

    now = scratch.write(ordered(edges.select("u", "v")), "edges")
    for _ in range(most_rounds):
        if settled(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = large.join(root, large.a == root.k)
        small = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).union(joined.select("a", "m"))
        new = scratch.write(ordered(small), "edges")
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(now.select("b", "b")).distinct()
