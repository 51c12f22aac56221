"""Append-only JSON lines: journals, metrics, defects and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = """at string, mapper_id string, source_sha string, declared long, mapped long, unmapped long, unresolved long, gate_passed boolean,
result_source struct<verified: long, cache: long, model: long, mixed: long>, model_calls long, duration_ms long,
tokens struct<prompt: long, completion: long, retries: long, latency_ms: long, p95_latency_ms: long>,
write_patterns map<string, long>, provenance map<string, long>, scores struct<coverage: double, grounding: double, specificity: double, provenance: double>,
possible_missed_writes long, unmapped_but_mentioned long, multi_instance_unattributed long, prompt_injection_risks long, cross_check_flips long,
grounding_warnings long, step_smells long, verify_divergences long, critic_findings long, outcome string"""
METRICS = "mapper_id string, at string, declared_fields long, labeled long, from_cache long, unresolved long, cross_check_flips long, tool_loop_runs long, tool_loop_resolved long"
DEFECTS = "at string, mapper_id string, field string, user_claim string, judge_evidence string, defect_id string"
TRACE = "at string, mapper_id string, field string, steps array<struct<tool: string, input: string, output_preview: string>>"


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append rows as JSON lines, one folder per value of the partition columns."""
    out = rows.write.mode("append")
    (out.partitionBy(*by) if by else out).json(path)


def try_append(rows: DataFrame, path: str) -> bool:
    """Append, but let a failure of the log not fail the run."""
    try:
        append(rows, path)
    except Exception:
        return False
    return True


def read(spark: SparkSession, path: str, schema: str = JOURNAL, strict: bool = True) -> DataFrame:
    """Rows of a log. A corrupt line is an error, or is left out if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def preview(trace: DataFrame, width: int = 400) -> DataFrame:
    """A trace with each output cut to its beginning."""
    cut = F.transform("steps", lambda s: F.struct(s["tool"].alias("tool"), s["input"].alias("input"), F.substring(s["output_preview"], 1, width).alias("output_preview")))
    return trace.withColumn("steps", cut)


def format_trace(trace: DataFrame, width: int = 120) -> DataFrame:
    """A line of text for every step."""
    t = trace.select("mapper_id", "field", F.posexplode("steps").alias("pos", "s"))
    return t.select("mapper_id", "field", "pos", F.format_string("%d. %s %s -> %s", F.col("pos") + 1, F.col("s.tool"), F.col("s.input"), F.substring("s.output_preview", 1, width)).alias("text"))
