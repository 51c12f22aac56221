"""Queries of ordered rows: filling, folding, grouping and closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import closure, journal, keyed, pipeline
from weftline.plans.registry import STEPS_SQL, query, steps, table


@query("carry_forward", f"WITH {STEPS_SQL} SELECT pos, CASE WHEN kind IN ('TRANSFORM', 'FILTER') THEN coalesce(source_field, last_value(CASE WHEN kind = 'READ' THEN source_field END IGNORE NULLS) OVER (PARTITION BY pipeline ORDER BY pos ROWS UNBOUNDED PRECEDING)) ELSE source_field END AS source_field FROM steps")
def carry_forward(spark, sf_dir):
    return pipeline.carry_forward(steps(spark, sf_dir)).select("pos", "source_field")


@query("terminal_writes", f"WITH {STEPS_SQL} SELECT pipeline, max(pos) + 1 AS pos FROM steps GROUP BY pipeline HAVING max_by(kind, pos) <> 'WRITE'")
def terminal_writes(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("given", F.lit(True))
    return pipeline.with_writes(s).where("given is null").select("pipeline", "pos")


@query(
    "fold_branches",
    f"""WITH {STEPS_SQL},
marked AS (SELECT *, last_value(CASE WHEN kind = 'FILTER' THEN pos END IGNORE NULLS) OVER (PARTITION BY pipeline ORDER BY pos ROWS UNBOUNDED PRECEDING) AS f FROM steps),
counted AS (SELECT *, sum(CASE WHEN kind IN ('FILTER', 'TRANSFORM') THEN 0 ELSE 1 END) OVER (PARTITION BY pipeline, f ORDER BY pos ROWS UNBOUNDED PRECEDING) AS other, row_number() OVER (PARTITION BY pipeline, f ORDER BY pos) AS n FROM marked)
SELECT pos, CASE WHEN f IS NOT NULL AND (kind = 'TRANSFORM' AND other = 0 OR kind = 'CONSTANT' AND n = 2) THEN f ELSE pos END AS parent FROM counted""",
)
def fold_branches(spark, sf_dir):
    return pipeline.fold_branches(steps(spark, sf_dir)).select("pos", "parent")


@query(
    "group_by_target",
    f"""WITH {STEPS_SQL}, t AS (SELECT pipeline, pos, kind, first_value(target_field IGNORE NULLS) OVER (PARTITION BY pipeline ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target_field FROM steps)
SELECT pipeline, target_field, string_agg(kind, '>' ORDER BY pos) AS kinds FROM t WHERE target_field IS NOT NULL GROUP BY pipeline, target_field""",
)
def group_by_target(spark, sf_dir):
    g = pipeline.group_by_target(steps(spark, sf_dir))
    return g.select("pipeline", "target_field", F.array_join(F.transform("ops", lambda o: o["kind"]), ">").alias("kinds"))


@query("collect_fields", f"WITH {STEPS_SQL} SELECT pipeline, coalesce(string_agg(DISTINCT source_field, ',' ORDER BY source_field), '') AS sources, coalesce(string_agg(DISTINCT target_field, ',' ORDER BY target_field), '') AS targets FROM steps GROUP BY pipeline")
def collect_fields(spark, sf_dir):
    c = pipeline.collect_fields(steps(spark, sf_dir), "pipeline")
    return c.select("pipeline", F.array_join("sources", ",").alias("sources"), F.array_join("targets", ",").alias("targets"))


@query("view_rows", f"WITH {STEPS_SQL} SELECT pos, lower(kind) AS view_kind, CASE kind WHEN 'TRANSFORM' THEN 'Keep digits' WHEN 'FILTER' THEN 'matches' END AS label, CASE WHEN kind IN ('WRITE', 'CONSTANT') THEN 'Out.' || target_field END AS target FROM steps WHERE NOT (kind = 'WRITE' AND target_field IS NULL)")
def view_rows(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("target_field", F.when((F.col("kind") == "WRITE") & F.col("target_field").isNull(), "<return>").otherwise(F.col("target_field")))
    s = s.withColumn("op", F.lit("keepDigits")).withColumn("condition", F.lit("c")).withColumn("value", F.lit("v")).withColumn("schema_path", F.lit(None).cast("string"))
    return pipeline.view_steps(s, F.lit("Out")).select("pos", "view_kind", "label", "target")


@query("expand_writes", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'read,read,transform,write' WHEN 1 THEN 'transform,write' ELSE 'write' END AS kinds FROM events")
def expand_writes(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, 't.setName(s.getFirstName() + " " + s.getLastName())').when(F.col("event_id") % 3 == 1, "t.code = c.toUpperCase()").otherwise("t.x = y")
    steps_ = pipeline.expand_write(text, F.lit("Source"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(steps_, lambda s: s["kind"]), ",").alias("kinds"))


@query("kind_counts", f"WITH {STEPS_SQL} SELECT kind, count(*) AS n FROM steps GROUP BY kind")
def kind_counts(spark, sf_dir):
    return journal.counts(steps(spark, sf_dir), "kind")


@query("recent_top_k", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def recent_top_k(spark, sf_dir):
    return keyed.top_per(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"], 3).select("user_id", "event_id")


@query(
    "helper_closure",
    """WITH RECURSIVE edges AS (SELECT c_custkey AS a, c_custkey * 7 + c_nationkey AS b FROM customer UNION SELECT c_custkey, c_custkey // 2 FROM customer),
walk(start, node, depth) AS (SELECT DISTINCT c_custkey, c_custkey, 0 FROM customer UNION SELECT start, b, depth + 1 FROM walk JOIN edges ON node = a WHERE depth < 5)
SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node""",
)
def helper_closure(spark, sf_dir):
    """The closure of every customer over whole keys."""
    c = table(spark, sf_dir, "customer")
    edges = c.select(F.col("c_custkey").alias("caller"), F.explode(F.array(F.col("c_custkey") * 7 + F.col("c_nationkey"), F.expr("c_custkey div 2"))).alias("callee"))
    return closure.reach(c.select(F.col("c_custkey").alias("start"), F.col("c_custkey").alias("node")), edges)


@query("superclass_chain", "SELECT CAST(n_nationkey AS VARCHAR) AS name, concat_ws('>', CASE WHEN n_nationkey >= 2 THEN CAST(n_nationkey // 2 AS VARCHAR) END, CASE WHEN n_nationkey >= 4 THEN CAST(n_nationkey // 4 AS VARCHAR) END, CASE WHEN n_nationkey >= 8 THEN CAST(n_nationkey // 8 AS VARCHAR) END) AS ancestors FROM nation")
def superclass_chain(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.when(F.col("n_nationkey") >= 2, F.floor(F.col("n_nationkey") / 2).cast("string")).alias("parent"))
    return closure.superclasses(n).select("name", F.array_join("ancestors", ">").alias("ancestors"))


def types(spark, sf_dir):
    """Classes made from suppliers, nations and regions: (class_name, name, type, pos)."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = lambda d, *fields: d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), t.alias("type"), F.lit(k).alias("pos")) for k, (n, t) in enumerate(fields)])).alias("f"), "class_name").select("class_name", "f.*")
    s = table(spark, sf_dir, "supplier").withColumn("class_name", named("S", "s_suppkey"))
    n = table(spark, sf_dir, "nation").withColumn("class_name", named("N", "n_nationkey"))
    r = table(spark, sf_dir, "region").withColumn("class_name", named("R", "r_regionkey"))
    a = rows(s, ("name", F.lit("String")), ("home", named("N", "s_nationkey")), ("twin", named("com.x.S", "s_suppkey")), ("all", F.concat(F.lit("List<"), named("N", "s_nationkey"), F.lit(">"))))
    b = rows(n, ("label", F.lit("string[]")), ("region", named("R", "n_regionkey")))
    return a.unionByName(b).unionByName(rows(r, ("title", F.lit("Map<String, Gone>")), ("far", F.lit("x.Gone[]"))))


@query("nested_leaves", """WITH inner_ AS (SELECT unnest(['label', 'region.title', 'region.far']) AS p, unnest([NULL, NULL, 'type not found']) AS reason)
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS mapper_id, path, reason FROM supplier, (SELECT 'name' AS path, NULL AS reason UNION ALL SELECT 'twin', 'cycle' UNION ALL SELECT 'home.' || p, reason FROM inner_ UNION ALL SELECT 'all[].' || p, reason FROM inner_)""")
def nested_leaves(spark, sf_dir):
    """The leaves of every supplier's type, all at once."""
    roots = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("mapper_id")).withColumn("class_name", F.col("mapper_id"))
    leaves, told, _ = closure.nested_leaves(types(spark, sf_dir), roots)
    return leaves.join(told, ["mapper_id", "path"], "left").select("mapper_id", "path", "reason")


@query("store_upsert", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'new' ELSE s_name END AS name FROM supplier UNION ALL SELECT -1, 'new'")
def store_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), "s_nationkey")
    new = s.where("s_nationkey < 10").select("s_suppkey", F.lit("new").alias("name"))
    new = new.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("s_suppkey"), F.lit("new").alias("name")))
    return keyed.upsert(s.drop("s_nationkey"), new, ["s_suppkey"])


@query("value_precedence", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'v' WHEN c_acctbal > 0 THEN 'c' END AS value, CASE WHEN c_mktsegment = 'BUILDING' THEN 'verified' WHEN c_acctbal > 0 THEN 'cache' END AS found_in FROM customer")
def value_precedence(spark, sf_dir):
    from weftline.sources.files import precedence

    c = table(spark, sf_dir, "customer")
    return precedence(c.select("c_custkey"), "c_custkey", verified=c.where("c_mktsegment = 'BUILDING'").withColumn("value", F.lit("v")), cache=c.where("c_acctbal > 0").withColumn("value", F.lit("c")))


@query("locale_sort", "SELECT c_name, row_number() OVER (ORDER BY c_name) AS place FROM customer")
def locale_sort(spark, sf_dir):
    """Names in the order of their locale, with their places: sorted ranges are numbered where they are, as a whole table can't be in one task."""
    return pipeline.numbered(table(spark, sf_dir, "customer").select("c_name"), F.collate("c_name", "UNICODE"), "place")
