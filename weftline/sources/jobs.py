"""Offline jobs: documents handed to a labeler or judge, and their results."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import judge_outcome, quotes_real_code, verified_citation

JOB = "mapper_id string, fingerprint string, fields array<struct<field: string, state: string, slice: string>>"
RESULT = "mapper_id string, fingerprint string, results array<struct<field: string, recognised: boolean, pipeline: array<struct<kind: string, source_field: string, condition: string, op: string, value: string>>>>"
GOLDEN = "mapper_id string, fields array<struct<target_field: string, pipeline_kinds: array<string>>>"


def write_documents(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON document per row, in a folder per value of the partition columns."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def views(rows: DataFrame, key: str) -> DataFrame:
    """key and the row as JSON text."""
    return rows.select(key, F.to_json(F.struct("*")).alias("json"))


def export_job(fields: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """A job per mapper from its fields (mapper_id, field, state, slice); unmapped ones have nothing to label."""
    own = fields.where("state <> 'unmapped'").groupBy("mapper_id").agg(F.array_sort(F.collect_list(F.struct("field", "state", F.when(F.col("state") == "mapped", F.col("slice")).alias("slice")))).alias("fields"))
    return fingerprints.select("mapper_id", "fingerprint").join(own, "mapper_id")


def import_results(jobs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recognised results of the job's fingerprint (slices are the job's, never the result's), and the fields without one. Of several for a field the last in its list counts."""
    asked = jobs.select("mapper_id", "fingerprint", F.explode("fields").alias("f")).select("mapper_id", "fingerprint", "f.*").withColumn("_k", F.lower("field"))
    got = results.select("mapper_id", "fingerprint", F.posexplode("results").alias("pos", "r")).where("r.recognised and size(r.pipeline) > 0")
    got = got.groupBy("mapper_id", "fingerprint", F.lower("r.field").alias("_k")).agg(F.max_by("r.pipeline", F.struct("pos", "r.pipeline")).alias("pipeline"))
    keys = ["mapper_id", "fingerprint", "_k"]
    return asked.join(got, keys).drop("_k"), asked.join(got, keys, "left_anti").drop("_k")


def without_result(asked: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """What was asked and has no result yet."""
    return asked.join(results.select(*keys).distinct(), keys, "left_anti")


def goldens(documents: DataFrame) -> DataFrame:
    """mapper_id, target_field and kinds of every golden field."""
    return documents.select("mapper_id", F.explode("fields").alias("f")).select("mapper_id", "f.target_field", F.col("f.pipeline_kinds").alias("kinds"))


def seed_store(golden: DataFrame, fingerprint: str, now: str) -> DataFrame:
    """Store rows that stand for the goldens, for runs without answers."""
    return golden.select("mapper_id", F.lit(fingerprint).alias("fingerprint"), "target_field", "kinds", F.lit("verified").alias("status"), F.lit(now).alias("updated_at"))


def inside(root: str, path: str) -> str:
    """The path below the root, without dots; one that leads out of it is an error."""
    out: list[str] = []
    for part in PurePosixPath(path.replace("\\", "/")).parts:
        if part == "..":
            if not out:
                raise ValueError(f"{path} leads out of {root}")
            out.pop()
        elif part == "/":
            raise ValueError(f"{path} is absolute")
        elif part != ".":
            out.append(part)
    return "/".join([root.rstrip("/"), *out])


JUDGE_RESULT = "mapper_id string, fingerprint string, field string, verdict struct<agree: string, evidence: string, reason: string, pipeline: array<struct<kind: string, source_field: string, condition: string, op: string, value: string>>>"


def _leaf(name: str) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def export_judge(claims: DataFrame, tasks: DataFrame, sources: DataFrame, store: DataFrame) -> DataFrame:
    """A judge job for each claim (mapper_id, field, claim): its task's slice, the source, and the stored pipeline.

    A field is the task's of that name in any case, or else one of the same leaf. tasks: (mapper_id, field, slice_text); sources:
    (mapper_id, fingerprint, text); store: (mapper_id, fingerprint, target_field, pipeline). A claim without a task gives no job.
    """
    t = tasks.select("mapper_id", F.col("field").alias("_field"), "slice_text", _leaf("field").alias("_k"))
    met = claims.withColumn("_k", _leaf("field")).join(t, ["mapper_id", "_k"])
    best = F.min(F.struct((F.lower("_field") != F.lower("field")).alias("o"), F.col("_field").alias("name"), "slice_text")).alias("t")
    own = met.groupBy("mapper_id", "_k", "field", "claim").agg(best)
    known = store.groupBy("mapper_id", "fingerprint", _leaf("target_field").alias("_k")).agg(F.min_by("pipeline", "target_field").alias("current_pipeline"))
    out = own.join(sources.select("mapper_id", "fingerprint", "text"), "mapper_id").join(known, ["mapper_id", "fingerprint", "_k"], "left")
    return out.select("mapper_id", "fingerprint", F.col("t.name").alias("field"), F.col("claim").alias("user_claim"), F.col("t.slice_text").alias("slice_text"), F.col("text").alias("source"), "current_pipeline")


def import_judge(jobs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the results (``JUDGE_RESULT``) of exported jobs, and the results that match no job.

    What is cited is looked up in the job's slice and source, each for itself, never in anything that the result brings. A line is
    one of the source, however many the slice has.
    """
    keys = ["mapper_id", "fingerprint", "field"]
    met = results.join(jobs, keys)
    agree = F.coalesce(F.lower("verdict.agree").isin("true", "yes"), F.lit(False))
    said = F.col("verdict.evidence")
    cited = verified_citation(said, F.col("source")) | F.coalesce(quotes_real_code(said, F.col("slice_text")), F.lit(False))
    fix = F.coalesce(F.size("verdict.pipeline") > 0, F.lit(False))
    out = met.select(*keys, "user_claim", F.col("verdict.evidence").alias("evidence"), F.col("verdict.pipeline").alias("pipeline"), judge_outcome(agree, cited, fix).alias("outcome"))
    return out, results.join(jobs.select(*keys), keys, "left_anti")
