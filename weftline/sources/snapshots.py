"""Snapshots of file trees, and what changed between two: folder digests rolled up, and a descent into unequal folders only.

A snapshot is written as two tables: ``folders`` (path, parent, depth, digest) and ``files`` (folder, path, sha), the latter in partitions by a hash of the folder. A
folder's digest covers its own files and its folders' digests. It is made of sums, which don't depend on the order, so no task gathers a folder's files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.tables import Workspace

#: Partitions of a snapshot's files.
BUCKETS = 64


def _summed(*cols: Column) -> list[Column]:
    """How many rows there are and two sums of 60 bits of each one's hash: alike for the same rows in any order."""
    digest = F.sha2(F.concat_ws("\\x00", *cols), 256)
    return [F.count("*").alias("n"), *[F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(2)]]


def folder_of(path: str) -> Column:
    """The folder of a path, empty for the top one."""
    return F.regexp_replace(path, r"(?:^|/)[^/]*$", "")


def write(files: DataFrame, root: str, content: str = "content") -> None:
    """Write the snapshot of files (path and content, or path and sha)."""
    spark = files.sparkSession
    sha = F.col("sha") if "sha" in files.columns else F.sha2(F.col(content).cast("binary"), 256)
    each = files.select(folder_of("path").alias("folder"), "path", sha.alias("sha"))
    bucket = F.pmod(F.xxhash64("folder"), F.lit(BUCKETS)).cast("int")
    each.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/files")
    kept = read_files(spark, root)
    work = Workspace(spark)
    own = kept.groupBy("folder").agg(*_summed(F.lit("file"), F.col("path"), F.col("sha")))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    # every folder that has files, and all above it
    parts = F.split("folder", "/")
    above = own.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path")).distinct()
    tree = work.keep(above.withColumn("depth", depth).withColumn("parent", F.when(F.col("path") != "", folder_of("path"))))
    sums = tree.join(own.withColumnRenamed("folder", "path"), "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    deepest = tree.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    below: DataFrame | None = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = sums.where(F.col("depth") == level)
        inner = F.lit("")
        if below is not None:
            kids = below.groupBy(F.col("parent").alias("path")).agg(*_summed(F.lit("folder"), F.col("path"), F.col("digest"))).select("path", F.concat_ws(",", "n", "s0", "s1").alias("inner"))
            rows, inner = rows.join(kids, "path", "left"), F.coalesce("inner", F.lit(""))
        digest = F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.coalesce(F.col("s0").cast("string"), F.lit("")), F.coalesce(F.col("s1").cast("string"), F.lit("")), inner), 256)
        below = work.keep(rows.select("path", "parent", "depth", digest.alias("digest")))
        levels.append(below)
    empty = spark.createDataFrame([], "path string, parent string, depth int, digest string")
    reduce(DataFrame.unionByName, levels, empty).write.mode("overwrite").parquet(f"{root}/folders")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("folder string, path string, sha string, bucket int").parquet(f"{root}/files")


def unequal(spark: SparkSession, base: str, head: str) -> DataFrame:
    """folder: those that differ themselves or somewhere below, found from the top down; the folders of equal ones are not looked at."""
    work = Workspace(spark)
    a, b = (spark.read.parquet(f"{root}/folders") for root in (base, head))
    now: DataFrame | None = None
    found: list[DataFrame] = []
    deepest = max((t.agg(F.max("depth")).first()[0] if t.head(1) else -1) for t in (a, b))
    for level in range(deepest + 1):
        sides = [t.where(F.col("depth") == level) for t in (a, b)]
        if now is not None:
            open_ = now.withColumnRenamed("folder", "parent")
            sides = [s.join(open_, "parent", "left_semi") for s in sides]
        old, new = (s.select(F.col("path").alias("folder"), F.col("digest").alias(name)) for s, name in zip(sides, ("_a", "_b"), strict=True))
        now = work.keep(old.join(new, "folder", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("folder"))
        if now.isEmpty():
            break
        found.append(now)
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "folder string"))


def changed(spark: SparkSession, base: str, head: str) -> DataFrame:
    """path and change (added, removed or changed) of the files in which two snapshots differ; only partitions of unequal folders are read."""
    folders = Workspace(spark).keep(unequal(spark, base, head))
    buckets = [r[0] for r in folders.select(F.pmod(F.xxhash64("folder"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # at most BUCKETS numbers
    old, new = (read_files(spark, root).where(F.col("bucket").isin(buckets)).join(folders, "folder", "left_semi").select("path", F.col("sha").alias(name)) for root, name in ((base, "_a"), (head, "_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return old.join(new, "path", "full_outer").select("path", change.alias("change")).where("change is not null")
