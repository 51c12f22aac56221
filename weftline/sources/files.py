"""File trees and keyed result tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a walk leaves out.
SKIPPED = ["node_modules", ".git", ".cache", "dist", "build", "target", "out", ".idea", ".gradle", ".vscode", "coverage"]


def tree(spark: SparkSession, root: str, suffix: str = "", depth: int = 10, limit: int | None = None) -> DataFrame:
    """path (relative), content and length of the files below a folder, skipped folders left out, least deep first if limited.

    Names are listed first, as the engine's file index does; only the files that are wanted are opened.
    """
    base = re.sub("^file:/*", "/", root).rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = raw.option("pathGlobFilter", f"*{suffix}") if suffix else raw
    short = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/", "")
    parts = F.split("short", "/")
    names = raw.load(root).select(short.alias("short"), "path").where((F.size(parts) <= depth) & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIPPED))))
    if limit is not None:
        names = names.orderBy(F.size(parts), "short").limit(limit)
    wanted = [r.path for r in names.collect()]
    if not wanted:
        return spark.createDataFrame([], "path string, content string, length long")
    return spark.read.format("binaryFile").load(wanted).select(short.alias("path"), F.col("content").cast("string").alias("content"), "length")


def tree_hash(files: DataFrame) -> DataFrame:
    """A hash of 40 hex digits over all paths and contents in order: each file is hashed where it is, and one row per file meets."""
    each = files.select(F.struct("path", F.sha2("path", 256).alias("p"), F.sha2("content", 256).alias("c")).alias("f"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(f["p"], f["c"])), "")
    return each.agg(F.substring(F.sha2(joined, 256), 1, 40).alias("sha"))


def read_lines(lines: DataFrame, start: int, end: int, most: int = 120) -> DataFrame:
    """Lines start to end of each text, at most ``most``."""
    return lines.where(F.col("line").between(start, min(end, start + most - 1)))


def search(lines: DataFrame, query: str, k: int, by: str | None = None) -> DataFrame:
    """The first k lines that hold the query, in any case; of each text if ``by`` is given."""
    from weftline.operators.keyed import top_per

    hits = lines.where(F.contains(F.lower("text"), F.lit(query.lower())))
    return top_per(hits, [by], [F.col("line")], k) if by else hits.orderBy(*[c for c in hits.columns if c != "text"]).limit(k)


def newest(spark: SparkSession, root: str, key: Column, suffix: str = "") -> DataFrame:
    """key, path and modified of each key's newest file below a folder, of equal times the one of the greater name.

    ``key`` is made of the column path (relative to the folder); files of a null key are left out. Names and times are what the engine lists; no file is opened.
    """
    base = re.sub("^file:/*", "/", root).rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = raw.option("pathGlobFilter", f"*{suffix}") if suffix else raw
    listed = raw.load(root).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    named = listed.withColumn("path", F.regexp_replace(F.regexp_replace("file", "^file:/*", "/"), f"^{re.escape(base)}/", "")).withColumn("key", key).where("key is not null")
    return named.groupBy("key").agg(F.max(F.struct("modified", "path", "file")).alias("f")).select("key", "f.path", "f.modified", "f.file")


def newest_rows(spark: SparkSession, root: str, key: Column, schema: str, suffix: str = ".json") -> DataFrame:
    """Rows of the JSON documents that are their key's newest, with key and path; the others aren't opened."""
    wanted = newest(spark, root, key, suffix).select("file", "key", "path").collect()  # a row a key, as the engine's own list of files
    if not wanted:
        return spark.createDataFrame([], f"{schema}, key string, path string")
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json([r.file for r in wanted]).withColumn("file", F.col("_metadata.file_path"))
    return rows.join(spark.createDataFrame(wanted, "file string, key string, path string"), "file").drop("file")


def put(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that the rows belong to and no others; each is put in place when it is complete."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def get(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """Rows of the given keys; only their partitions are read."""
    out = spark.read.parquet(path)
    for k, v in keys.items():
        out = out.where(F.col(k) == v)
    return out


def clear(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not there yet."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def precedence(request: DataFrame, key: str, **sources: DataFrame) -> DataFrame:
    """Requested keys with the value of the first source that has one, and that source's name."""
    out = request
    for name, s in sources.items():
        out = out.join(s.select(key, F.col("value").alias(f"_{name}")), key, "left")
    cols = [f"_{n}" for n in sources]
    out = out.withColumn("value", F.coalesce(*cols)).withColumn("found_in", F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c[1:])) for c in cols]))
    return out.drop(*cols)


#: Fixed value: the layout of stored entries that readers know.
STORE_FORMAT = 1


def get_entry(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """Rows of a stored entry, if it is of the known format; one of another format counts as absent."""
    return get(spark, path, **keys).where(F.col("format") == STORE_FORMAT)


class Cache:
    """Results by kind (label, pipeline, discovery or field) and key, as JSON documents in a folder for each; put replaces what a key had."""

    KINDS = ("label", "pipeline", "discovery", "field")

    def __init__(self, spark: SparkSession, root: str, kind: str, schema: str):
        if kind not in self.KINDS:
            raise ValueError(f"no such cache: {kind}")
        self.spark, self.path, self.schema = spark, f"{root.rstrip('/')}/{kind}", schema

    def put(self, rows: DataFrame) -> None:
        """Rows with a column key; all rows of a key are replaced together."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").json(self.path)

    def list(self) -> DataFrame:
        """All rows; documents that can't be read are left out."""
        return self.spark.read.schema(f"{self.schema}, key string").option("mode", "DROPMALFORMED").json(self.path)

    def get(self, key: str) -> DataFrame:
        return self.list().where(F.col("key") == key)

    def clear(self) -> None:
        clear(self.spark, self.path)


def resolve_sources(mappers: DataFrame, local: DataFrame, worktree: DataFrame | None = None, cached: DataFrame | None = None, trees: DataFrame | None = None) -> DataFrame:
    """mapper_id, text and found_in of each mapper's source (mapper_id, source_file).

    A worktree (path, text) alone counts where there is one, and a file it lacks is an error. Else for mappers in the cache (path,
    commit_sha: the newest one) the local file, or that of the commit's tree (commit_sha, path, text); then the local file. What is
    nowhere has to be fetched: remote.
    """
    own = mappers.select("mapper_id", F.col("source_file").alias("path"))
    if worktree is not None:
        out = own.join(worktree.select("path", "text"), "path", "left")
        lost = F.raise_error(F.concat(F.lit("not in the worktree: "), "path")).cast("string")
        return out.select("mapper_id", F.coalesce("text", lost).alias("text"), F.lit("worktree").alias("found_in"))
    out = own.join(local.select("path", F.col("text").alias("_local")), "path", "left")
    tree = F.lit(None).cast("string")
    if cached is not None and trees is not None:
        out = out.join(cached.select("path", "commit_sha"), "path", "left").join(trees.select("path", "commit_sha", F.col("text").alias("_tree")), ["path", "commit_sha"], "left")
        tree = F.col("_tree")
    found = F.when(F.col("_local").isNotNull(), "local").when(tree.isNotNull(), "cache").otherwise("remote")
    return out.select("mapper_id", F.coalesce("_local", tree).alias("text"), found.alias("found_in"))
