"""Run journals: sums, means, rates and scorecards over appended rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.store import CORRECTED, PENDING

#: Counters of a run that count as misses.
MISS_COUNTERS = ["unmapped", "unresolved", "possible_missed_writes", "unmapped_but_mentioned", "multi_instance_unattributed", "prompt_injection_risks", "cross_check_flips", "grounding_warnings", "step_smells"]


def runs(journal: DataFrame, mapper_id: str | None = None, since: str | None = None, at: str = "at") -> DataFrame:
    """Rows of a mapper from a time on; times are compared as ISO text, and rows without one are left out."""
    out = journal if mapper_id is None else journal.where(F.col("mapper_id") == mapper_id)
    return out if since is None else out.where(F.col(at) >= since)


def defects(rows: DataFrame, since: str | None = None) -> DataFrame:
    """As runs, but rows without a time pass."""
    return rows if since is None else rows.where(F.col("at").isNull() | (F.col("at") >= since))


def total(name: str) -> Column:
    """Sum with null as 0, and 0 over no rows."""
    return F.coalesce(F.sum(F.coalesce(F.col(name), F.lit(0))), F.lit(0)).alias(name.replace(".", "_"))


def sums(journal: DataFrame, counters: list[str], by: list[str] | None = None) -> DataFrame:
    return journal.groupBy(*(by or [])).agg(F.count("*").alias("runs"), *map(total, counters))


def map_sums(journal: DataFrame, column: str) -> DataFrame:
    """Sum of each key of a map column."""
    return journal.select(F.explode(column)).groupBy("key").agg(F.sum("value").alias("total"))


def means(journal: DataFrame, scores: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over the rows that have the score, rounded to 4 places; null if none has."""
    return journal.groupBy(*(by or [])).agg(*[F.round(F.avg(s), 4).alias(s.split(".")[-1]) for s in scores])


def top_unresolved(journal: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent (mapper, unresolved count) pairs; of equal counts the one seen first."""
    some = journal.where(F.col("unresolved") > 0).withColumn("key", F.concat("mapper_id", F.lit(":unresolved×"), F.col("unresolved").cast("string")))
    return some.groupBy("key").agg(F.count("*").alias("count"), F.min("pos").alias("first_seen")).orderBy(F.desc("count"), "first_seen").limit(k)


def agree_rate(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """agrees / (agrees + rejects); null without verdicts."""
    out = verdicts.groupBy(*(by or [])).agg(F.count_if("agree").alias("agrees"), F.count_if(~F.col("agree")).alias("rejects"))
    return out.withColumn("agree_rate", F.round(F.try_divide(F.col("agrees").cast("double"), F.col("agrees") + F.col("rejects")), 4))


def miss_total(counters: list[str] = MISS_COUNTERS) -> Column:
    out = F.lit(0)
    for c in counters:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def p95(name: str) -> Column:
    """Nearest-rank 95th percentile of a column, 0 over no rows, for groups of moderate size; ``p95_by`` for any."""
    return F.coalesce(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {name})"), F.lit(0))


def p95_by(rows: DataFrame, by: list[str], name: str, bins: int = 4096, most: int = 100_000) -> DataFrame:
    """by and p95: the nearest-rank 95th percentile of each group, 0 where it has no value; exact, and no task holds more than ``most`` values of a group.

    The engine's own percentile holds a group's distinct values; it is asked where a sketch counts no more than ``most``. Else equal values are
    counted first, the counts are summed over bins of a group's range, and only the values of the bin in which the rank falls are ordered.
    """
    if (rows.groupBy(*by).agg(F.approx_count_distinct(name).alias("_d")).agg(F.max("_d")).first()[0] or 0) <= 0.9 * most:
        return rows.groupBy(*by).agg(p95(f"cast(`{name}` as double)").cast("double").alias("p95"))
    values = rows.groupBy(*by, F.col(name).cast("double").alias("_v")).agg(F.count(name).alias("_c"))
    span = values.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    rank = F.greatest(F.ceil(0.95 * F.col("_n")), F.lit(1))
    at = F.coalesce(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    binned = values.where("_c > 0").join(span, by).withColumn("_bin", F.floor(at * bins).cast("int"))
    sums = binned.groupBy(*by, "_bin").agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin"))
    hit = sums.withColumn("_upto", upto).where((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank))
    inside = binned.drop("_n").join(hit.select(*by, "_bin", "_n", (F.col("_upto") - F.col("_c")).alias("_before")), [*by, "_bin"])
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*by).orderBy("_v")))
    found = inside.where(F.col("_upto") >= rank).groupBy(*by).agg(F.min("_v").alias("p95"))
    return span.select(*by).join(found, by, "left").withColumn("p95", F.coalesce("p95", F.lit(0.0)))


def recent(journal: DataFrame, k: int = 10, by: list[str] | None = None, order: str = "pos") -> DataFrame:
    """The last k rows, newest first. Without groups it is a top-k of the engine."""
    if not by:
        return journal.orderBy(F.desc(order)).limit(k)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return journal.withColumn("recency", n).where(F.col("recency") <= k)


def trend(journal: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each row with the change of its value since the row before."""
    return journal.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order)))


def concerns(card: DataFrame) -> DataFrame:
    """A scorecard's worries as an array, and whether a strict report fails: any worry at all."""
    worry = F.array_compact(
        F.array(
            F.when(F.col("unresolved") > 0, F.concat(F.col("unresolved").cast("string"), F.lit(" unresolved"))),
            F.when(F.col("unmapped") > 0, F.concat(F.col("unmapped").cast("string"), F.lit(" unmapped"))),
            F.when(F.col("status") != "current", F.concat(F.lit("store is "), F.col("status"))),
            F.when(F.col("agree_rate") < 0.5, F.lit("low agree rate")),
        )
    )
    return card.withColumn("concerns", worry).withColumn("strict_fail", F.size("concerns") > 0)


def health(store: DataFrame, statuses: DataFrame) -> DataFrame:
    """Counts of the store's rows and of stale mappers, in one row."""
    one = store.agg(F.count("*").alias("entries"), F.count_if(F.col("status") == CORRECTED).alias("corrected"), F.count_if(F.col("status") == PENDING).alias("pending"))
    return one.join(F.broadcast(statuses.agg(F.count_if(F.col("status") == "stale").alias("stale"))), how="cross")


def counts(rows: DataFrame, by: str) -> DataFrame:
    """How many rows there are of each kind."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def mappers_and_runs(journal: DataFrame, by: str = "mapper_id") -> DataFrame:
    """How many mappers a journal has and how many runs, in one row."""
    each = journal.groupBy(by).agg(F.count("*").alias("_n"))
    return each.agg(F.count(by).alias("mappers"), F.coalesce(F.sum("_n"), F.lit(0)).alias("runs"))


def provider_counters(calls: DataFrame, by: list[str]) -> DataFrame:
    """Per run: calls, retries, tokens, latency in all and its 95th percentile, from a table of calls (by, retries, prompt, completion, latency_ms)."""
    sums = calls.groupBy(*by).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("retries", "prompt", "completion", "latency_ms")])
    return sums.join(p95_by(calls, by, "latency_ms").withColumnRenamed("p95", "p95_latency_ms"), by)
