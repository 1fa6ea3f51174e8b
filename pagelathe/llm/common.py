"""What the corpus operators share: tables, the shared folder, distributed ranks, components."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir, as in tests.
OWN_SHARED_DIR = "file:///tmp/checkpoints/pagelathe"

_folders: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder, as a URI, that driver and executors all see; it goes when the driver's process ends.

    It lies in spark.checkpoint.dir. Only where that is unset and all runs in one process does OWN_SHARED_DIR serve.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = OWN_SHARED_DIR
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_remove_folders)
    _folders[path] = spark
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared_folder() before the process ends."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _folders.pop(path, None)


def _remove_folders() -> None:
    for path, spark in list(_folders.items()):
        try:
            remove_folder(spark, path)
        except Exception:  # the JVM may be gone by now
            return


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


class scratch:
    """with scratch(spark) as s: tables that written() makes inside go at the end, but for those given to s.keep().

    What leaves the block must hang on kept tables alone. At both ends the driver collects garbage, so that shuffle files
    of finished jobs, which nothing can ask for any more, go too instead of staying for as long as the job runs.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.kept = spark, set()

    def __enter__(self) -> scratch:
        self._collect()
        self.before = set(_folders)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._folder)
        return df

    def __exit__(self, kind: type | None, *_: object) -> None:
        for path in [p for p in _folders if p not in self.before and p not in self.kept]:
            remove_folder(self.spark, path)
        self._collect()

    def _collect(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], identity: list[str], out: str = "rank") -> DataFrame:
    """Number the rows of each key from 0, in a repeatable order, also where one key has a third of the rows.

    Rows of a key are dealt into hash buckets; each (key, bucket) is numbered by itself, and the bucket
    counts, summed over the buckets before, shift the numbers. No task ever holds a whole key.
    """
    buckets = max(64, 2 * shuffle_partitions(df.sparkSession))
    hashed = F.xxhash64(*identity, F.lit(7))
    parts = df.withColumn("_hash", hashed).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        parts.groupBy(*keys, "_bucket")
        .count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_shift")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_hash", *identity)
    numbered = parts.withColumn("_n", F.row_number().over(inside) - 1)
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        numbered.join(shift, same)
        .withColumn(out, (F.col("_n") + F.col("_shift")).cast("long"))
        .drop("_hash", "_bucket", "_n", "_b", "_shift", *[f"_k{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge table; component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step is an aggregate and an
    equi-join, its result a written table; nothing but one count reaches the driver. Nodes without an edge
    do not appear.
    """
    with scratch(edges.sparkSession) as tables:
        now = tables.keep(_stars(edges, a, b, most_rounds))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _stars(edges: DataFrame, a: str, b: str, most_rounds: int) -> DataFrame:
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "star"
    )
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a plain table, so that adaptive execution can split the rows of a crowded centre
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "star")
        large = (
            both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = written(large, "star")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "star")
        small = (
            large.join(low, F.col("u") == F.col("w"))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        after = written(small, "star")
        same = now.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == same:
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now


def as_long(column: str) -> Column:
    return F.col(column).cast("long")
