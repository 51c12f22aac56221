"""Where the modules of queries register them, and the roles that the driver's tables play.

journal rows: events (at = ts, mapper = event_type or user_id, latency = value, counter = props.k)
store entries: orders (mapper = o_custkey, fingerprint = o_orderkey, updated_at = o_orderdate, status = o_orderstatus)
steps of a pipeline: events (pipeline = user_id, pos = event_id, kind by event_type)
declared and written fields: a mapper is a supplier, its fields the parts it sells, its writes lineitems in four files
field paths: p_name, p_type, c_name, url; source text: documents, conversations, pages, and sources made from suppliers
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Queries that no SQL expresses.
NO_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under a name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        (QUERIES if sql else NO_SQL)[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Kinds that event types stand for.
KIND = {"view": "READ", "click": "TRANSFORM", "purchase": "WRITE", "signup": "CONSTANT", "error": "FILTER"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items()) + " END"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pipeline, pos, kind, source_field and target_field from events: a third of the steps has no target."""
    kinds = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("pipeline"),
        F.col("event_id").alias("pos"),
        kinds[F.col("event_type")].alias("kind"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string"))).alias("source_field"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))).alias("target_field"),
    )


STEPS_SQL = f"""steps AS (SELECT user_id AS pipeline, event_id AS pos, {KIND_SQL} AS kind,
  CASE WHEN event_type = 'view' THEN 's' || CAST(event_id % 7 AS VARCHAR) END AS source_field,
  CASE WHEN event_id % 3 > 0 THEN 't' || CAST(event_id % 5 AS VARCHAR) END AS target_field FROM events)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at (ISO text), mapper_id, pos, latency and k from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("event_type").alias("mapper_id"), F.col("event_id").alias("pos"), F.col("user_id").alias("user_id"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("long").alias("k"))


JOURNAL_SQL = """journal AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "at", event_type AS mapper_id, event_id AS pos, user_id, value AS latency,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mapper_id, fingerprint, updated_at and status from orders."""
    names = F.create_map(F.lit("F"), F.lit("verified"), F.lit("O"), F.lit("user-corrected"), F.lit("P"), F.lit("pending-review"))
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("mapper_id"), F.col("o_orderkey").alias("fingerprint"), F.col("o_orderdate").alias("updated_at"), names[F.col("o_orderstatus")].alias("status"))


VERSIONS_SQL = """versions AS (SELECT o_custkey AS mapper_id, o_orderkey AS fingerprint, o_orderdate AS updated_at,
  CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'user-corrected' WHEN 'P' THEN 'pending-review' END AS status FROM orders)"""
