"""Queries over run journals and stored versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.names import norm
from weftline.operators import journal as jr
from weftline.operators import store as so
from weftline.plans.registry import JOURNAL_SQL, VERSIONS_SQL, journal, query, table, versions


@query("journal_sums", f"WITH {JOURNAL_SQL} SELECT mapper_id, count(*) AS runs, CAST(coalesce(sum(coalesce(k, 0)), 0) AS BIGINT) AS k, CAST(sum(user_id) AS BIGINT) AS user_id FROM journal WHERE \"at\" >= '2024-01-05' GROUP BY mapper_id")
def journal_sums(spark, sf_dir):
    return jr.sums(jr.runs(journal(spark, sf_dir), since="2024-01-05"), ["k", "user_id"], ["mapper_id"])


@query("journal_map_sums", f"WITH {JOURNAL_SQL} SELECT key, CAST(sum(total) AS BIGINT) AS total FROM (SELECT mapper_id AS key, k AS total FROM journal UNION ALL SELECT 'all', k FROM journal) WHERE key IS NOT NULL GROUP BY key")
def journal_map_sums(spark, sf_dir):
    return jr.map_sums(journal(spark, sf_dir).select(F.create_map("mapper_id", "k", F.lit("all"), "k").alias("m")), "m")


@query("journal_means", f"WITH {JOURNAL_SQL} SELECT user_id, round(sum(CAST(latency AS DECIMAL(18, 6))) / count(latency), 2)::DOUBLE AS latency FROM journal GROUP BY user_id")
def journal_means(spark, sf_dir):
    j = journal(spark, sf_dir)
    return j.groupBy("user_id").agg(F.round(F.sum(F.col("latency").cast("decimal(18,6)")).cast("double") / F.count("latency"), 2).alias("latency"))


@query("score_means", f"WITH {JOURNAL_SQL} SELECT mapper_id, round(avg(k / 100.0::DOUBLE), 4) AS score FROM journal WHERE k % 2 = 0 GROUP BY mapper_id")
def score_means(spark, sf_dir):
    j = journal(spark, sf_dir).withColumn("score", F.when(F.col("k") % 2 == 0, F.col("k") / 100.0))
    return jr.means(j, ["score"], ["mapper_id"])


@query("top_unresolved", f"WITH {JOURNAL_SQL} SELECT mapper_id || ':unresolved×' || CAST(k % 40 AS VARCHAR) AS key, count(*) AS count, min(pos) AS first_seen FROM journal WHERE k % 40 > 0 GROUP BY 1 ORDER BY count DESC, first_seen LIMIT 20")
def top_unresolved(spark, sf_dir):
    return jr.top_unresolved(journal(spark, sf_dir).withColumn("unresolved", F.col("k") % 40))


@query("distinct_mappers", "SELECT count(DISTINCT user_id) AS mappers, count(*) AS runs FROM events")
def distinct_mappers(spark, sf_dir):
    return jr.mappers_and_runs(table(spark, sf_dir, "events"), "user_id")


@query("agree_rate", "SELECT doc_id % 10 AS mapper_id, count(*) FILTER (WHERE quality = toxic) AS agrees, count(*) FILTER (WHERE quality <> toxic) AS rejects, round(count(*) FILTER (WHERE quality = toxic) / nullif(count(*), 0)::DOUBLE, 4) AS agree_rate FROM labels GROUP BY 1")
def agree_rate(spark, sf_dir):
    v = table(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("mapper_id"), (F.col("quality") == F.col("toxic")).alias("agree"))
    return jr.agree_rate(v, ["mapper_id"])


@query("miss_total", f"WITH {JOURNAL_SQL} SELECT pos, coalesce(k, 0) + coalesce(CASE WHEN user_id % 2 = 0 THEN user_id END, 0) AS misses FROM journal")
def miss_total(spark, sf_dir):
    j = journal(spark, sf_dir).withColumn("half", F.when(F.col("user_id") % 2 == 0, F.col("user_id")))
    return j.select("pos", jr.miss_total(["k", "half"]).alias("misses"))


@query("p95_latency", f"WITH {JOURNAL_SQL} SELECT mapper_id, coalesce(quantile_disc(latency, 0.95), 0) AS p95 FROM journal GROUP BY mapper_id")
def p95_latency(spark, sf_dir):
    return jr.p95_by(journal(spark, sf_dir), ["mapper_id"], "latency")


@query("recent_runs", f"WITH {JOURNAL_SQL} SELECT user_id, pos, recency FROM (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS recency FROM journal) WHERE recency <= 10")
def recent_runs(spark, sf_dir):
    return jr.recent(journal(spark, sf_dir), 10, ["user_id"]).select("user_id", "pos", F.col("recency").cast("long").alias("recency"))


@query("last_runs", "SELECT event_id AS pos FROM events ORDER BY event_id DESC LIMIT 10")
def last_runs(spark, sf_dir):
    return jr.recent(journal(spark, sf_dir), 10).select("pos")


@query("coverage_trend", f"WITH {JOURNAL_SQL} SELECT pos, k, k - lag(k) OVER (PARTITION BY user_id ORDER BY pos) AS delta FROM journal")
def coverage_trend(spark, sf_dir):
    return jr.trend(journal(spark, sf_dir), "user_id", "pos", "k").select("pos", "k", "delta")


@query("defect_rows", f"WITH {JOURNAL_SQL} SELECT pos FROM journal WHERE pos % 5 = 0 OR \"at\" >= '2024-01-15'")
def defect_rows(spark, sf_dir):
    j = journal(spark, sf_dir).withColumn("at", F.when(F.col("pos") % 5 > 0, F.col("at")))
    return jr.defects(j, "2024-01-15").select("pos")


@query("status_counts", f"WITH {VERSIONS_SQL} SELECT mapper_id, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'user-corrected') AS user_corrected, count(*) FILTER (WHERE status = 'pending-review') AS pending_review FROM versions GROUP BY mapper_id")
def status_counts(spark, sf_dir):
    return so.status_counts(versions(spark, sf_dir))


@query("latest_per_key", f"WITH {VERSIONS_SQL} SELECT mapper_id, fingerprint, status FROM (SELECT *, row_number() OVER (PARTITION BY mapper_id ORDER BY updated_at DESC, fingerprint) AS n FROM versions) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return so.latest_per(versions(spark, sf_dir), "mapper_id", "updated_at", "fingerprint").select("mapper_id", "fingerprint", "status")


CURRENT_SQL = "current_version AS (SELECT mapper_id, max(fingerprint) AS fingerprint FROM versions GROUP BY mapper_id)"


def current(v):
    return v.groupBy("mapper_id").agg(F.max("fingerprint").alias("fingerprint"))


@query("previous_entry", f"WITH {VERSIONS_SQL}, {CURRENT_SQL} SELECT mapper_id, fingerprint, updated_at FROM (SELECT v.*, row_number() OVER (PARTITION BY v.mapper_id ORDER BY updated_at DESC, v.fingerprint DESC) AS n FROM versions v JOIN current_version c ON v.mapper_id = c.mapper_id AND v.fingerprint <> c.fingerprint) WHERE n = 1")
def previous_entry(spark, sf_dir):
    v = versions(spark, sf_dir)
    return so.previous(v, current(v))


@query("prune_rank", f"WITH {VERSIONS_SQL}, {CURRENT_SQL} SELECT v.mapper_id, v.fingerprint, v.fingerprint = c.fingerprint OR row_number() OVER (PARTITION BY v.mapper_id, v.fingerprint = c.fingerprint ORDER BY updated_at DESC, v.fingerprint) <= 2 AS kept FROM versions v JOIN current_version c ON v.mapper_id = c.mapper_id")
def prune_rank(spark, sf_dir):
    v = versions(spark, sf_dir)
    return so.prune(v, current(v), 3).select("mapper_id", "fingerprint", "kept")


@query("store_approve", f"WITH {VERSIONS_SQL} SELECT fingerprint, CASE WHEN status = 'pending-review' THEN 'verified' ELSE status END AS status FROM versions")
def store_approve(spark, sf_dir):
    return so.approve(versions(spark, sf_dir)).select("fingerprint", "status")


@query(
    "drift_status",
    """WITH known AS (SELECT DISTINCT o_custkey AS m, o_orderkey AS f FROM orders WHERE o_orderstatus = 'F'),
mappers AS (SELECT c_custkey AS mapper_id, CASE WHEN c_custkey % 50 > 0 THEN (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) END AS fingerprint FROM customer)
SELECT mapper_id, fingerprint, CASE WHEN fingerprint IS NULL THEN 'unresolvable' WHEN NOT EXISTS (SELECT 1 FROM known WHERE m = mapper_id) THEN 'never-verified'
  WHEN EXISTS (SELECT 1 FROM known WHERE m = mapper_id AND f = fingerprint) THEN 'current' ELSE 'stale' END AS status FROM mappers""",
)
def drift_status(spark, sf_dir):
    v = versions(spark, sf_dir)
    latest = v.groupBy("mapper_id").agg(F.max("fingerprint").alias("fingerprint"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mapper_id")).join(latest, "mapper_id", "left")
    c = c.withColumn("fingerprint", F.when(F.col("mapper_id") % 50 > 0, F.col("fingerprint")))
    return so.drift(c, v.where("status = 'verified'"))


GOLDEN_SQL = "golden AS (SELECT doc_id, 'a.F' || CAST(doc_id AS VARCHAR) AS target_field, CASE WHEN quality = 1 THEN ['READ', 'WRITE'] ELSE ['CONSTANT'] END AS kinds FROM labels)"
FOUND_SQL = "CASE WHEN lang = 'en' THEN ['READ', 'WRITE'] ELSE ['CONSTANT'] END"


def golden(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    kinds = F.when(F.col("quality") == 1, F.array(F.lit("READ"), F.lit("WRITE"))).otherwise(F.array(F.lit("CONSTANT")))
    return lab.select(F.concat(F.lit("a.F"), F.col("doc_id").cast("string")).alias("target_field"), kinds.alias("kinds"))


def labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") + 50)
    kinds = F.when(F.col("lang") == "en", F.array(F.lit("READ"), F.lit("WRITE"))).otherwise(F.array(F.lit("CONSTANT")))
    return d.select(F.concat(F.lit("b.f"), F.col("doc_id").cast("string")).alias("target_field"), kinds.alias("kinds"), F.col("doc_id").alias("pos"))


@query("golden_compare", f"WITH {GOLDEN_SQL} SELECT target_field, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN {FOUND_SQL} = kinds THEN 'matched' ELSE 'mismatched' END AS outcome FROM golden g LEFT JOIN (SELECT * REPLACE (doc_id + 50 AS doc_id) FROM documents) d ON g.doc_id = d.doc_id")
def golden_compare(spark, sf_dir):
    return so.compare_golden(golden(spark, sf_dir), labelled(spark, sf_dir)).select("target_field", "outcome")


@query("store_diff", f"WITH {GOLDEN_SQL} SELECT 'f' || CAST(coalesce(g.doc_id, d.doc_id) AS VARCHAR) AS k, CASE WHEN g.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' WHEN kinds <> {FOUND_SQL} THEN 'kinds-changed' ELSE 'unchanged' END AS change FROM golden g FULL JOIN (SELECT * REPLACE (doc_id + 50 AS doc_id) FROM documents) d ON g.doc_id = d.doc_id")
def store_diff(spark, sf_dir):
    return so.diff(golden(spark, sf_dir), labelled(spark, sf_dir)).select("k", "change")


@query(
    "store_merge",
    f"""WITH {VERSIONS_SQL}, fresh AS (SELECT mapper_id, fingerprint + CASE WHEN fingerprint % 4 = 0 THEN 10000000 ELSE 0 END AS fingerprint FROM versions WHERE status <> 'pending-review')
SELECT coalesce(v.mapper_id, f.mapper_id) AS mapper_id, coalesce(v.fingerprint, f.fingerprint) AS fingerprint, CASE WHEN f.fingerprint IS NULL OR coalesce(v.status, '') = 'user-corrected' THEN v.status ELSE 'pending-review' END AS status
FROM versions v FULL JOIN fresh f ON v.mapper_id = f.mapper_id AND v.fingerprint = f.fingerprint""",
)
def store_merge(spark, sf_dir):
    v = versions(spark, sf_dir).select("mapper_id", "fingerprint", F.lit("f").alias("target_field"), "status")
    fresh = v.where("status <> 'pending-review'").select("mapper_id", (F.col("fingerprint") + F.when(F.col("fingerprint") % 4 == 0, 10_000_000).otherwise(0)).alias("fingerprint"), "target_field", F.lit("pending-review").alias("status"))
    return so.promote(v, fresh, "now").select("mapper_id", "fingerprint", "status")


@query("store_correct", "SELECT o_orderkey AS fingerprint, CASE WHEN o_orderpriority = '1-URGENT' THEN 'user-corrected' ELSE o_orderstatus END AS status FROM orders")
def store_correct(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mapper_id"), F.col("o_orderkey").alias("fingerprint"), F.lit("f").alias("target_field"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return so.correct(o.drop("o_orderpriority"), o.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority")).select("fingerprint", "status")


@query("health_counts", f"WITH {VERSIONS_SQL} SELECT count(*) AS entries, count(*) FILTER (WHERE status = 'user-corrected') AS corrected, count(*) FILTER (WHERE status = 'pending-review') AS pending, (SELECT count(*) FROM (SELECT mapper_id, max(fingerprint) f, max(CASE WHEN status = 'verified' THEN fingerprint END) g FROM versions GROUP BY mapper_id) WHERE g IS NOT NULL AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.status = 'verified' AND v.fingerprint = f)) AS stale FROM versions")
def health_counts(spark, sf_dir):
    v = versions(spark, sf_dir)
    latest = v.groupBy("mapper_id").agg(F.max("fingerprint").alias("fingerprint"))
    return jr.health(v, so.drift(latest, v.where("status = 'verified'")))


CARD_SQL = f"""WITH {JOURNAL_SQL}, {VERSIONS_SQL},
runs AS (SELECT user_id AS mapper_id, count(*) AS runs, CAST(sum(coalesce(k, 0)) AS BIGINT) AS k, quantile_disc(latency, 0.95) AS p95, CAST(sum(CASE WHEN mapper_id = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM journal WHERE "at" >= '2024-01-02' GROUP BY user_id),
latest AS (SELECT mapper_id, fingerprint, status AS latest_status FROM (SELECT *, row_number() OVER (PARTITION BY mapper_id ORDER BY updated_at DESC, fingerprint) AS n FROM versions) WHERE n = 1),
known AS (SELECT mapper_id, max(fingerprint) AS top FROM versions WHERE status = 'verified' GROUP BY mapper_id)
SELECT r.mapper_id, runs, k, p95, unresolved, l.fingerprint, latest_status,
  CASE WHEN l.fingerprint IS NULL THEN 'unresolvable' WHEN n.top IS NULL THEN 'never-verified' WHEN latest_status = 'verified' THEN 'current' ELSE 'stale' END AS status
FROM runs r LEFT JOIN latest l ON r.mapper_id = l.mapper_id LEFT JOIN known n ON r.mapper_id = n.mapper_id"""


def card(spark, sf_dir):
    j = jr.runs(journal(spark, sf_dir), since="2024-01-02").withColumn("mapper", F.col("user_id"))
    sums = j.groupBy(F.col("user_id").alias("mapper_id")).agg(F.count("*").alias("runs"), jr.total("k"), F.count_if(F.col("mapper_id") == "error").alias("unresolved"))
    sums = sums.join(jr.p95_by(j.select(F.col("user_id").alias("mapper_id"), "latency"), ["mapper_id"], "latency"), "mapper_id")
    v = versions(spark, sf_dir)
    latest = so.latest_per(v, "mapper_id", "updated_at", "fingerprint").select("mapper_id", "fingerprint", F.col("status").alias("latest_status"))
    return so.drift(sums.join(latest, "mapper_id", "left"), v.where("status = 'verified'"))


@query("scorecard", CARD_SQL)
def scorecard(spark, sf_dir):
    """The report's core: filtered sums and percentile by mapper, its latest version and drift status."""
    return card(spark, sf_dir).select("mapper_id", "runs", "k", "p95", "unresolved", "fingerprint", "latest_status", "status")


@query("concerns", f"SELECT mapper_id, concat_ws('; ', CASE WHEN unresolved > 0 THEN CAST(unresolved AS VARCHAR) || ' unresolved' END, CASE WHEN k % 3 > 0 THEN CAST(k % 3 AS VARCHAR) || ' unmapped' END, CASE WHEN status <> 'current' THEN 'store is ' || status END, CASE WHEN k % 5 < 2 THEN 'low agree rate' END) AS concerns, unresolved > 0 OR k % 3 > 0 OR status <> 'current' OR k % 5 < 2 AS strict_fail FROM ({CARD_SQL})")
def concerns(spark, sf_dir):
    c = card(spark, sf_dir).withColumn("unmapped", F.col("k") % 3).withColumn("agree_rate", (F.col("k") % 5) / 4.0)
    return jr.concerns(c).select("mapper_id", F.array_join("concerns", "; ").alias("concerns"), "strict_fail")


@query("ci_summary", "WITH m AS (SELECT c_custkey, 'src/' || CAST(c_nationkey AS VARCHAR) || '/C' || CAST(c_custkey AS VARCHAR) || '.java' AS f FROM customer WHERE c_nationkey < 3), k AS (SELECT o_custkey, max(o_orderkey) AS top, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS good FROM orders GROUP BY 1) SELECT count(*) AS checked, count(*) FILTER (WHERE good IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = top AND o_orderstatus = 'F')) AS stale, count(*) FILTER (WHERE good IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = top AND o_orderstatus = 'F')) = 0 AS ok FROM m LEFT JOIN k ON c_custkey = o_custkey")
def ci_summary(spark, sf_dir):
    v = versions(spark, sf_dir)
    file = F.concat(F.lit("src/"), F.col("c_nationkey").cast("string"), F.lit("/C"), F.col("c_custkey").cast("string"), F.lit(".java"))
    latest = v.groupBy("mapper_id").agg(F.max("fingerprint").alias("fingerprint"))
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mapper_id"), file.alias("source_file")).join(latest, "mapper_id", "left")
    changed = table(spark, sf_dir, "customer").where("c_nationkey < 3").select(F.concat(F.lit("repo/"), file).alias("path"))
    return so.ci_check(m, v.where("status = 'verified'"), changed)


@query("checklist_join", f"WITH {GOLDEN_SQL}, s AS (SELECT doc_id + 50 AS doc_id FROM documents) SELECT target_field AS field, CASE WHEN s.doc_id IS NOT NULL THEN 'verified' WHEN kinds = ['CONSTANT'] THEN 'cache' ELSE 'none' END AS available FROM golden g LEFT JOIN s ON g.doc_id = s.doc_id")
def checklist_join(spark, sf_dir):
    fields = golden(spark, sf_dir).select(F.col("target_field").alias("field"))
    cache = golden(spark, sf_dir).where(F.size("kinds") == 1).withColumn("pos", F.lit(0))
    return so.checklist_view(fields, labelled(spark, sf_dir), cache).select("field", "available")


@query("distinct_by_leaf", "SELECT k, min(p_partkey) AS p_partkey FROM (SELECT lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')) AS k, p_partkey FROM part) GROUP BY k")
def distinct_by_leaf(spark, sf_dir):
    from weftline.operators.keyed import first_by

    p = table(spark, sf_dir, "part").withColumn("k", norm(F.col("p_name")))
    return first_by(p, F.col("k"), [F.col("p_partkey")]).select("k", "p_partkey")
