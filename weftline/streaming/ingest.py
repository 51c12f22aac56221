"""Polling as a stream: new files are read once, merged by key, and the checkpoint advances after the merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def poll(spark: SparkSession, folder: str, schema: str, checkpoint: str, merge: Callable[[DataFrame, int], None], every: str | None = None, fmt: str = "json"):
    """Start a query that hands each batch of new files to ``merge``; without ``every`` it takes what is there and ends.

    Every call reads new files only. A batch that fails is handed over again after a restart, so ``merge`` must give the same result when repeated.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    out = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def newest(key: str | list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """Of each key the row of greatest order, of equal orders the greatest row."""
    keys = [key] if isinstance(key, str) else key

    def combine(rows: DataFrame) -> DataFrame:
        values = F.struct(*[c for c in rows.columns if c not in keys])
        return rows.groupBy(*keys).agg(F.max_by(values, F.struct(order, values)).alias("r")).select(*keys, "r.*")

    return combine


def merger(path: str, combine: Callable[[DataFrame], DataFrame], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """Merge batches into a Parquet table that ``combine`` keeps: whatever it is given of rows or of its own results, its result is the same as of all rows.

    A batch writes what ``combine`` makes of its own rows, as a part of its own. Once the parts beside the first are as large as it, all become one, so what is
    written stays in proportion to what came in. The list of a version's parts, written last, makes it count; parts that only versions
    older than the last ``keep`` name are deleted. A batch that is handed over again writes its part and list again, so the result is the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = versions_of(spark, path, number)
        parts = [*(before[max(before)] if before else []), f"batch={number}"]
        combine(batch).write.mode("overwrite").parquet(f"{path}/{parts[-1]}")
        if len(parts) > 1 and sum(_bytes(spark, f"{path}/{p}") for p in parts[1:]) >= _bytes(spark, f"{path}/{parts[0]}"):
            one = f"whole={number}"
            combine(spark.read.parquet(*[f"{path}/{p}" for p in parts])).write.mode("overwrite").parquet(f"{path}/{one}")
            parts = [one]
        listed = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "pos int, part string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{number}")
        old = sorted(before)[: -(keep - 1)] if keep > 1 else sorted(before)
        kept = {p for n in before if n not in old for p in before[n]} | {*parts}
        for n in old:
            for p in {*before[n]} - kept:
                _delete(spark, f"{path}/{p}")
            _delete(spark, f"{path}/versions/{n}")
        if parts[-1] != f"batch={number}":
            _delete(spark, f"{path}/batch={number}")

    return merge


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, name: str) -> None:
    fs, p = _path(spark, name)
    fs.delete(p, True)


def _bytes(spark: SparkSession, name: str) -> int:
    fs, p = _path(spark, name)
    return fs.getContentSummary(p).getLength()


def versions_of(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[str]]:
    """The parts of each complete version, in order."""
    fs, p = _path(spark, f"{path}/versions")
    if not fs.exists(p):
        return {}
    found = [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return {n: [r.part for r in spark.read.parquet(f"{path}/versions/{n}").orderBy("pos").collect()] for n in found if below is None or n < below}


def current(spark: SparkSession, path: str, combine: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The newest complete version of a merged table."""
    found = versions_of(spark, path)
    if not found:
        return None
    parts = found[max(found)]
    rows = spark.read.parquet(*[f"{path}/{p}" for p in parts])
    return rows if len(parts) == 1 else combine(rows)


def totals(by: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Sums of all other columns of partial states, by key; a maximum or minimum of those called max_ or min_."""

    def combine(states: DataFrame) -> DataFrame:
        kinds = {"max_": F.max, "min_": F.min}
        return states.groupBy(*by).agg(*[kinds.get(c[:4], F.sum)(c).alias(c) for c in states.columns if c not in by])

    return combine


def run_states(journal: DataFrame, counters: list[str], by: list[str], since: str | None = None) -> DataFrame:
    """Partial states of journal rows (by, at, the counters, agree_rate if there is one), which ``totals`` adds up: runs, sums of counters, sum and number of rates, newest time."""
    from weftline.operators.journal import runs

    rows = runs(journal, since=since)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters]
    rate = [F.sum("agree_rate").alias("rates"), F.count("agree_rate").alias("rated")] if "agree_rate" in journal.columns else []
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), *sums, *rate, F.max("at").alias("max_at"))


def run_report(states: DataFrame, counters: list[str], by: list[str]) -> DataFrame:
    """A row for each key of the states: runs, sums, their means, the mean agree rate (1 over none), and the newest time."""
    means = [F.round(F.try_divide(F.col(c).cast("double"), F.col("runs")), 4).alias(f"mean_{c}") for c in counters]
    rate = [F.coalesce(F.round(F.try_divide("rates", "rated"), 4), F.lit(1.0)).alias("agree_rate")] if "rates" in states.columns else []
    return states.select(*by, "runs", *counters, *means, *rate, F.col("max_at").alias("last_at"))


def report(spark: SparkSession, folder: str, schema: str, checkpoint: str, path: str, counters: list[str], by: list[str], since: str | None = None, fmt: str = "json", reading: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The report of all journal files of a folder. Only files that no call before has read are read; they are added to the states kept in ``path``.

    ``reading`` may turn the files' rows into journal rows; ``since`` belongs to the states and can't change later.
    """
    combine = totals(by)
    add = merger(path, combine)

    def take(batch: DataFrame, number: int) -> None:
        add(run_states(reading(batch) if reading else batch, counters, by, since), number)

    poll(spark, folder, schema, checkpoint, take, fmt=fmt).awaitTermination()
    states = current(spark, path, combine)
    return run_report(states, counters, by)


def plan_scan(state: DataFrame, head: str, changed: DataFrame, scope: list[str], mappers: DataFrame) -> DataFrame:
    """What a poll has to do, as one row: skip (same head), full (no state), advance (nothing in scope) or incremental with the mappers."""
    from weftline.functions.names import in_scope

    last = state.agg(F.max("last_sha").alias("last_sha"))
    hit = mappers.join(changed.where(in_scope(F.col("path"), scope)), F.col("source_file") == F.col("path"), "left_semi").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    inside = changed.where(in_scope(F.col("path"), scope)).agg(F.count("*").alias("n"))
    row = last.join(hit, how="cross").join(inside, how="cross")
    action = F.when(F.col("last_sha").isNull(), "full").when(F.col("last_sha") == head, "skip").when(F.col("n") == 0, "advance").otherwise("incremental")
    return row.select(action.alias("action"), F.when(action == "incremental", F.col("ids")).otherwise(F.array().cast("array<string>")).alias("mapper_ids"))


STATE = "repo string, last_sha string, at long"


def last_sha(spark: SparkSession, path: str, repo: str) -> str | None:
    """The commit that a repository was last scanned at."""
    fs, p = _path(spark, path)
    row = spark.read.schema(STATE).json(path).where(F.col("repo") == repo).agg(F.max_by("last_sha", "at")).first() if fs.exists(p) else None
    return row[0] if row else None


def scan_once(spark: SparkSession, path: str, repo: str, head: str, changed: DataFrame, scope: list[str], mappers: DataFrame, scan: Callable[[list[str]], None]) -> dict:
    """Do what a poll asks for and note the commit, after the scan and only if it succeeded: action, and the mappers' ids.

    mappers: (id, source_file); changed: (path) since the last commit. The same commit is skipped, a first one scans all mappers, a
    later one those whose source is a changed file of the scope; where there are none, only the commit is noted.
    """
    before = last_sha(spark, path, repo)
    if before == head:
        return {"action": "skip", "reason": "same_sha", "mappers": []}
    if before is None:
        wanted, done = [r.id for r in mappers.select("id").orderBy("id").collect()], {"action": "scan", "mode": "full"}
    else:
        state = spark.createDataFrame([(before,)], "last_sha string")
        plan = plan_scan(state, head, changed, scope, mappers).first()
        wanted = plan.mapper_ids
        done = {"action": "skip", "reason": "no_in_scope_changes"} if plan.action == "advance" else {"action": "scan", "mode": "incremental"} if wanted else {"action": "skip", "reason": "changed_not_registered"}
    if done["action"] == "scan":
        scan(wanted)
    n = spark.read.schema(STATE).json(path).count() if before is not None else 0
    spark.createDataFrame([(repo, head, n + 1)], STATE).coalesce(1).write.mode("append").json(path)
    return done | {"mappers": wanted}


def live_summary(stream: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts and sums by time window and key, with late rows up to the watermark; an extension of the journal's batch sums."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
