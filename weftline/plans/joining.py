"""Queries of audits and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import audit, keyed
from weftline.plans.registry import query, table
from weftline.plans.texts import CITED_SQL

#: A mapper is a supplier. Declared: the parts it sells. Written: a write for each lineitem, in one of four files, to the part of
#: the next lower multiple of 3, and some to none; lines repeat in every file.
PART = "CASE WHEN l_partkey % 2 = 0 THEN 'a.{}' ELSE 'p' END"
FIELDS_SQL = f"fields AS (SELECT DISTINCT l_suppkey AS mapper_id, {PART.format('p')} || CAST(l_partkey AS VARCHAR) AS field FROM lineitem)"
SITES_SQL = f"sites AS (SELECT l_suppkey AS mapper_id, 'F' || CAST(l_orderkey % 4 AS VARCHAR) AS path, {PART.format('P')} || CAST(l_partkey - l_partkey % 3 + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS VARCHAR) AS target_field, l_linenumber * 7 AS line, l_returnflag AS via, l_linestatus AS in_method, 'r' || CAST(l_linenumber % 2 AS VARCHAR) AS receiver FROM lineitem)"


def fields(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("mapper_id"), F.concat(F.when(F.col("l_partkey") % 2 == 0, "a.p").otherwise("p"), F.col("l_partkey").cast("string")).alias("field")).distinct()


def in_file(name: str, of: int = 4) -> F.Column:
    return F.concat(F.lit("F"), (F.col(name) % of).cast("string"))


def sites(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey") - F.col("l_partkey") % 3 + F.when(F.col("l_linenumber") == 7, 100_000_000).otherwise(0)
    target = F.concat(F.when(F.col("l_partkey") % 2 == 0, "a.P").otherwise("p"), key.cast("string"))
    return l.select(F.col("l_suppkey").alias("mapper_id"), in_file("l_orderkey").alias("path"), target.alias("target_field"), (F.col("l_linenumber") * 7).alias("line"), F.col("l_returnflag").alias("via"), F.col("l_linestatus").alias("in_method"), F.concat(F.lit("r"), (F.col("l_linenumber") % 2).cast("string")).alias("receiver"))


KEYED_SQL = f"""WITH {FIELDS_SQL}, {SITES_SQL},
ks AS (SELECT *, lower(regexp_replace(target_field, '[^a-zA-Z0-9]', '', 'g')) AS fk, lower(regexp_replace(list_last(string_split(target_field, '.')), '[^a-zA-Z0-9]', '', 'g')) AS lk FROM sites),
kf AS (SELECT *, lower(regexp_replace(field, '[^a-zA-Z0-9]', '', 'g')) AS fk, lower(regexp_replace(list_last(string_split(field, '.')), '[^a-zA-Z0-9]', '', 'g')) AS lk FROM fields),
n AS (SELECT mapper_id, fk, count(*) AS n FROM ks GROUP BY mapper_id, fk),
checked AS (SELECT kf.mapper_id, field, kf.fk, kf.lk, a.n IS NOT NULL AS whole, coalesce(a.n, b.n) AS n_writes FROM kf LEFT JOIN n a ON kf.mapper_id = a.mapper_id AND kf.fk = a.fk LEFT JOIN n b ON kf.mapper_id = b.mapper_id AND kf.lk = b.fk)"""


@query("audit_checklist", f"{KEYED_SQL} SELECT mapper_id, field, coalesce(n_writes, 0) AS n_writes, CASE WHEN n_writes IS NULL THEN 'unmapped' ELSE 'mapped' END AS state FROM checked")
def audit_checklist(spark, sf_dir):
    return audit.checklist(fields(spark, sf_dir), sites(spark, sf_dir))


@query("audit_writes", f"{KEYED_SQL} SELECT c.mapper_id, c.field, s.path, s.line, s.via, count(*) AS n FROM checked c JOIN ks s ON c.mapper_id = s.mapper_id AND s.fk = CASE WHEN whole THEN c.fk ELSE c.lk END GROUP BY ALL")
def audit_writes(spark, sf_dir):
    """The writes of every field as rows, counted by place."""
    return audit.writes(fields(spark, sf_dir), sites(spark, sf_dir)).groupBy("mapper_id", "field", "path", "line", "via").agg(F.count("*").alias("n"))


ORPHANS_SQL = "orphan AS (SELECT mapper_id, path, target_field, line FROM ks WHERE NOT EXISTS (SELECT 1 FROM kf WHERE kf.mapper_id = ks.mapper_id AND kf.fk = ks.fk) AND NOT EXISTS (SELECT 1 FROM kf WHERE kf.mapper_id = ks.mapper_id AND kf.lk = ks.lk))"


@query("audit_gate", f"{KEYED_SQL}, {ORPHANS_SQL}, lost AS (SELECT mapper_id, count(*) AS n FROM orphan GROUP BY mapper_id) SELECT c.mapper_id, count(*) AS declared, count(n_writes) AS mapped, count(*) - count(n_writes) AS unmapped, 0::BIGINT AS unresolved, CAST(round(100.0 * count(n_writes) / count(*)) AS BIGINT) AS mapped_pct, any_value(l.n) IS NULL AS gate_passed FROM checked c LEFT JOIN lost l ON c.mapper_id = l.mapper_id GROUP BY c.mapper_id")
def audit_gate(spark, sf_dir):
    f, s = fields(spark, sf_dir), sites(spark, sf_dir)
    return audit.gate(audit.checklist(f, s), audit.orphans(f, s))


@query("orphan_writes", f"{KEYED_SQL}, {ORPHANS_SQL} SELECT mapper_id, path, target_field, line FROM orphan")
def orphan_writes(spark, sf_dir):
    return audit.orphans(fields(spark, sf_dir), sites(spark, sf_dir)).select("mapper_id", "path", "target_field", "line")


CALLS_SQL = "calls AS (SELECT event_id, user_id AS mapper_id, 'F' || CAST(event_id % 4 AS VARCHAR) AS path, event_id % 9 * 7 AS line, CASE WHEN event_type = 'error' THEN 'Helper' ELSE event_type END AS callee, 'r' || CAST(event_id % 5 AS VARCHAR) AS word FROM events), away AS (SELECT event_id, mapper_id FROM calls c WHERE callee = 'Helper' AND NOT EXISTS (SELECT 1 FROM sites s WHERE s.mapper_id = c.mapper_id AND s.path = c.path AND s.line = c.line) AND EXISTS (SELECT 1 FROM sites s WHERE s.mapper_id = c.mapper_id AND s.receiver = c.word))"


def opaque(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    callee = F.when(F.col("event_type") == "error", "Helper").otherwise(F.col("event_type"))
    calls = e.select("event_id", F.col("user_id").alias("mapper_id"), in_file("event_id").alias("path"), (F.col("event_id") % 9 * 7).alias("line"), callee.alias("callee"), F.concat(F.lit("x, r"), (F.col("event_id") % 5).cast("string"), F.lit(".y")).alias("args"))
    return audit.opaque(calls, sites(spark, sf_dir))


@query("opaque_calls", f"WITH {SITES_SQL}, {CALLS_SQL} SELECT event_id FROM away")
def opaque_calls(spark, sf_dir):
    return opaque(spark, sf_dir).select("event_id")


@query("opaque_taint", f"{KEYED_SQL}, {CALLS_SQL} SELECT mapper_id, CASE WHEN n_writes IS NOT NULL THEN 'mapped' WHEN mapper_id IN (SELECT mapper_id FROM away) THEN 'unresolved' ELSE 'unmapped' END AS state, count(*) AS n FROM checked GROUP BY ALL")
def opaque_taint(spark, sf_dir):
    return audit.checklist(fields(spark, sf_dir), sites(spark, sf_dir), opaque(spark, sf_dir)).groupBy("mapper_id", "state").agg(F.count("*").alias("n"))


LOOSE_SQL = "loose AS (SELECT o_orderkey, o_custkey AS mapper_id, 'F' || CAST(o_orderkey % 4 AS VARCHAR) AS path, o_orderkey % 9 * 7 AS line, 'p' || CAST(o_orderkey % 2000 AS VARCHAR) AS k, 'x.setP' || CAST(o_orderkey % 2000 AS VARCHAR) || '(' AS evidence FROM orders)"


@query("missed_writes", f"{KEYED_SQL}, {LOOSE_SQL} SELECT o_orderkey, path, line, evidence FROM loose o WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.mapper_id = o.mapper_id AND s.path = o.path AND s.line = o.line) AND NOT EXISTS (SELECT 1 FROM ks WHERE ks.mapper_id = o.mapper_id AND ks.fk = o.k)")
def missed_writes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    loose = o.select("o_orderkey", F.col("o_custkey").alias("mapper_id"), in_file("o_orderkey").alias("path"), (F.col("o_orderkey") % 9 * 7).alias("line"), F.concat(F.lit("x.setP"), (F.col("o_orderkey") % 2000).cast("string"), F.lit("(")).alias("evidence"), F.lit("setter-like call").alias("hint"))
    return audit.missed_writes(loose, sites(spark, sf_dir)).select("o_orderkey", "path", "line", "evidence")


@query("unmapped_mentions", r"""WITH words AS (SELECT lang AS mapper_id, doc_id AS path, line, unnest(list_distinct(regexp_extract_all(text, '\w+'))) AS word FROM (SELECT lang, doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS text FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS parts FROM documents))),
named AS (SELECT DISTINCT lang AS mapper_id, regexp_extract(text, '\w+') AS f FROM documents WHERE regexp_matches(text, '\w')),
wanted AS (SELECT mapper_id, f, r AS rank, CASE r WHEN 4 THEN f ELSE ['set', 'get', 'is', 'with'][r + 1] || upper(f[1]) || f[2:] END AS word FROM named, (SELECT unnest([0, 1, 2, 3, 4]) AS r))
SELECT w.mapper_id, 'x.' || f AS field, CAST(arg_min(path, (rank, path, line)) AS BIGINT) AS path, CAST(arg_min(line, (rank, path, line)) AS INTEGER) AS line FROM wanted w JOIN words d ON w.mapper_id = d.mapper_id AND w.word = d.word GROUP BY w.mapper_id, f""")
def unmapped_mentions(spark, sf_dir):
    """A mapper is a language: the first word of every document is a field, looked up in all lines of all documents."""
    from weftline.functions.text import lines_of

    d = table(spark, sf_dir, "documents")
    word = F.regexp_extract("text", r"\w+", 0)
    named = d.where("lang is not null").select(F.col("lang").alias("mapper_id"), F.concat(F.lit("x."), word).alias("field"), word.alias("w")).where("w <> ''").drop("w").distinct()
    lines = lines_of(d.select(F.struct("lang", "doc_id").alias("d"), "text"), "d", "text").select(F.col("d.lang").alias("mapper_id"), F.col("d.doc_id").alias("path"), "line", "text")
    return audit.unmapped_mentions(named, lines).select("mapper_id", "field", "path", "line")


@query("enclosing_interval", """WITH spans AS (SELECT l_suppkey AS f, l_partkey AS lo, l_partkey + CAST(l_quantity * l_quantity AS BIGINT) AS hi, l_orderkey AS name FROM lineitem),
hits AS (SELECT event_id, arg_min(name, (hi - lo, lo, name)) AS name FROM events e JOIN spans s ON e.user_id = s.f AND e.event_id % 2500 BETWEEN lo AND hi GROUP BY event_id)
SELECT e.event_id, h.name FROM events e LEFT JOIN hits h ON e.event_id = h.event_id""")
def enclosing_interval(spark, sf_dir):
    """A file is a supplier; its spans begin at the parts it sells, and points are events."""
    l = table(spark, sf_dir, "lineitem")
    spans = l.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + (F.col("l_quantity") * F.col("l_quantity")).cast("long")).alias("hi"), F.col("l_orderkey").alias("name"))
    points = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2500).alias("line"), F.col("user_id").alias("file"))
    return keyed.innermost(points, spans, ["file"], "line", "lo", "hi", "name", ["event_id"])


@query("var_segments", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment FROM events")
def var_segments(spark, sf_dir):
    return keyed.segments(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "signup").select("event_id", "segment")


SEGMENT_SQL = "seg AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM events), inj AS (SELECT DISTINCT user_id, segment, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS parent FROM seg WHERE event_type = 'error'), n AS (SELECT user_id, segment, count(*) AS n FROM inj GROUP BY ALL), every AS (SELECT DISTINCT user_id, parent FROM inj)"


@query("multi_instance", f"WITH {SEGMENT_SQL} SELECT s.event_id, coalesce(i.parent, e.parent) AS parent, coalesce(n.n = 1, false) AS attributed FROM seg s LEFT JOIN n ON s.user_id = n.user_id AND s.segment = n.segment LEFT JOIN inj i ON s.user_id = i.user_id AND s.segment = i.segment LEFT JOIN every e ON n.n IS NULL AND s.user_id = e.user_id WHERE event_type = 'click'")
def multi_instance(spark, sf_dir):
    """Clicks go to the parents that errors of their segment name: one attributes, several taint each, none taints all of the user."""
    s = keyed.segments(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "signup")
    inj = s.where("event_type = 'error'").select("user_id", "segment", (F.get_json_object("props", "$.k").cast("long") % 7).alias("parent"))
    return keyed.attribute(s.where("event_type = 'click'"), inj, ["user_id"], "parent", inj).select("event_id", "parent", "attributed")


@query("builder_interval", """WITH b AS (SELECT user_id, event_id AS lo, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS hi FROM events WHERE event_type = 'signup')
SELECT e.event_id, b.lo AS opened_at FROM events e JOIN b ON e.user_id = b.user_id AND e.event_id > b.lo AND e.event_id < b.hi WHERE e.event_type = 'click'""")
def builder_interval(spark, sf_dir):
    """Sites between a builder's call and its build, with the user as equality key."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    closed = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    chains = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("var"), F.col("event_id").alias("start_line"), closed.alias("end_line"))
    return keyed.builder_sites(e.where("event_type = 'click'"), chains, ["user_id"], "event_id").select("event_id", F.col("var").alias("opened_at"))


@query("touched_mappers", "WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'n' || CAST(c_nationkey AS VARCHAR) || '.java' WHEN 1 THEN 'a/src/n' || CAST(c_nationkey AS VARCHAR) || '.java' ELSE 'b/n' || CAST(c_nationkey AS VARCHAR) END AS s FROM customer), p AS (SELECT 'src/n' || CAST(n_nationkey AS VARCHAR) || '.java' AS p FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'lib/n' || CAST(n_nationkey AS VARCHAR) || '.java.orig' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT '4' FROM region) SELECT c_custkey FROM c WHERE EXISTS (SELECT 1 FROM p WHERE contains(p, s) OR ends_with(s, p))")
def touched_mappers(spark, sf_dir):
    nation = F.col("c_nationkey").cast("string")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("n"), nation, F.lit(".java"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a/src/n"), nation, F.lit(".java"))).otherwise(F.concat(F.lit("b/n"), nation))
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    changed = n.where("n_regionkey = 1").select(F.concat(F.lit("src/n"), "k", F.lit(".java")).alias("path"))
    changed = changed.unionByName(n.where("n_regionkey = 2").select(F.concat(F.lit("lib/n"), "k", F.lit(".java.orig")).alias("path"))).unionByName(table(spark, sf_dir, "region").select(F.lit("4").alias("path")))
    return keyed.touched(table(spark, sf_dir, "customer").select("c_custkey", name.alias("source_file")), changed).select("c_custkey")


@query("changed_semi", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def changed_semi(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("path"))
    return keyed.changed(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "source_file"), n).select("c_custkey")


@query("provenance_semi", "SELECT count(*) AS mapped, count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 5)) AS with_slice, round(count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 5)) / count(*)::DOUBLE, 4) AS provenance FROM part")
def provenance_semi(spark, sf_dir):
    sliced = table(spark, sf_dir, "lineitem").where("l_linenumber > 5").select(F.col("l_partkey").alias("field"))
    return audit.provenance(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field")), sliced)


@query("selector_division", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def selector_division(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    n = table(spark, sf_dir, "nation")
    return keyed.uncovered(n, s, F.col("n_nationkey"), F.col("s_nationkey")).select("n_name")


@query("gap_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def gap_anti(spark, sf_dir):
    from weftline.sources.jobs import without_result

    return without_result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("cross_check", f"WITH {CITED_SQL} SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown field' WHEN d.lang <> 'en' THEN 'not unmapped' WHEN NOT coalesce(cited, false) THEN 'no citation' END AS dropped FROM labels l LEFT JOIN (SELECT * FROM documents WHERE source <> 'src0') d ON l.doc_id = d.doc_id LEFT JOIN cited c ON l.doc_id = c.doc_id")
def cross_check(spark, sf_dir):
    """Claims about documents, each with evidence that quotes its text or names a line of it, or neither."""
    d = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see `"), F.substring("text", 5, 20), F.lit("`"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see line "), (F.col("doc_id") % 100).cast("string"))).otherwise("see `never there at all 123`")
    claims = table(spark, sf_dir, "labels").select("doc_id").join(d.select("doc_id", "text", said.alias("evidence")), "doc_id", "left").withColumn("field", F.concat(F.lit("F"), F.col("doc_id").cast("string")))
    check = d.where("source <> 'src0'").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("field"), F.when(F.col("lang") == "en", "unmapped").otherwise("mapped").alias("state"))
    return audit.cross_check(claims, check, F.col("text")).select("doc_id", "dropped")


@query("closure_smells", "SELECT CAST(p_partkey AS VARCHAR) AS field, p_size % 4 AS steps, count(DISTINCT l_suppkey) AS closure_depth FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size % 4 BETWEEN 1 AND 2 GROUP BY p_partkey, p_size HAVING count(DISTINCT l_suppkey) >= 4")
def closure_smells(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("field"), F.col("l_suppkey").alias("helper"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("field"), F.array_repeat(F.lit(1), F.col("p_size") % 4).alias("pipeline"))
    return audit.smells(c, p)


@query("miss_classify", """SELECT kind, field, CAST(line AS INTEGER) AS line, count(*) AS n FROM (
  SELECT 'possible-missed-write' AS kind, NULL AS field, user_id AS line FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'unmapped-but-mentioned', 'f' || CAST(user_id AS VARCHAR), user_id FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'prompt-injection-risk', 'g', NULL FROM events WHERE event_type = 'error'
  UNION ALL SELECT CASE WHEN quality = 1 THEN 'unmapped' ELSE 'unresolved' END, 'd' || CAST(doc_id AS VARCHAR), NULL FROM labels
  UNION ALL SELECT 'cross-check', 'd' || CAST(doc_id AS VARCHAR), NULL FROM labels WHERE toxic = 1) GROUP BY ALL""")
def miss_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("possible-missed-write line "), u, F.lit(" (setter-like call): x"))).when(F.col("event_type") == "click", F.concat(F.lit("unmapped-but-mentioned f"), u, F.lit(" line "), u, F.lit(": y"))).when(F.col("event_type") == "error", "prompt-injection-risk g: z").otherwise("else")
    f = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("field"), F.when(F.col("quality") == 1, "unmapped").otherwise("unresolved").alias("state"), F.when(F.col("toxic") == 1, "cross-check: x").alias("note"))
    return audit.classify_misses(e.select(text.alias("text")), f).groupBy("kind", "field", "line").agg(F.count("*").alias("n"))


@query("label_scores", "SELECT round(least(1.0::DOUBLE, m / 200.0::DOUBLE), 4) AS coverage, round(1 - b / s::DOUBLE, 4) AS grounding, round(1 - r / s::DOUBLE, 4) AS specificity, round(p / m::DOUBLE, 4) AS provenance FROM (SELECT count(*) AS s, count(*) FILTER (WHERE event_type = 'error') AS r, count(*) FILTER (WHERE event_type = 'view' AND event_id % 2 = 0) AS b, count(DISTINCT user_id) AS m, count(DISTINCT CASE WHEN user_id % 3 > 0 THEN user_id END) AS p FROM events)")
def label_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("field", F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "error", "RAW").when(F.col("event_type") == "view", "READ").otherwise("WRITE")
    p = e.groupBy("field").agg(F.collect_list(F.struct(kind.alias("kind"))).alias("pipeline"))
    steps = e.select("field", F.col("event_id").alias("pos"), kind.alias("kind"), F.when(F.col("event_id") % 2 > 0, "seen").otherwise("gone").alias("source_field"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("value"))
    slices = e.select("field").distinct().withColumn("text", F.lit("x = in.getSeen()"))
    return audit.scores(p, 200, audit.ungrounded(steps, slices), slices.where("cast(field as long) % 3 > 0"))


@query("mapping_filter", "SELECT p_partkey FROM (SELECT p_partkey, lower(regexp_replace(p_type, '[^a-zA-Z0-9]', '', 'g')) AS t FROM part) WHERE length(t) > 0 AND (t LIKE '%steel' OR 'largetin' LIKE '%' || t OR t LIKE '%largetin')")
def mapping_filter(spark, sf_dir):
    """Mappings whose target a selector names."""
    from weftline.functions.names import matches_selectors

    return table(spark, sf_dir, "part").where(matches_selectors(F.col("p_type"), F.array(F.lit("STEEL"), F.lit("large tin")))).select("p_partkey")


@query("schema_leaf_match", "SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN 'root.n' || CAST(s_nationkey AS VARCHAR) || '.key_' || CAST(s_suppkey AS VARCHAR) WHEN c_custkey % 2 = 0 THEN 'x.Key' || CAST(c_custkey AS VARCHAR) ELSE 'T.Key' || CAST(c_custkey AS VARCHAR) END AS target FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def schema_leaf_match(spark, sf_dir):
    """Fields of customers, and a schema path for every supplier."""
    from weftline.functions.steps import write_target
    from weftline.operators.pipeline import schema_paths_for

    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "x.Key").otherwise("Key"), F.col("c_custkey").cast("string")).alias("field"))
    paths = table(spark, sf_dir, "supplier").select(F.concat(F.lit("root.n"), F.col("s_nationkey").cast("string"), F.lit(".key_"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_suppkey").alias("pos"))
    return schema_paths_for(c, paths).select("c_custkey", write_target(F.col("field"), F.lit("T"), F.col("schema_path")).alias("target"))


@query("steps_filter", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'a.name:1' ELSE 'a.name:0' END WHEN event_id % 3 = 0 THEN 'x.setName:0' ELSE '' END AS kept FROM events")
def steps_filter(spark, sf_dir):
    from weftline.operators.labeling import filter_steps

    child = F.struct(F.when(F.col("event_id") % 3 == 0, "x.setName").otherwise("x.other").alias("target_field"))
    step = F.struct(F.when(F.col("event_id") % 2 == 0, "a.name").otherwise("a.code").alias("target_field"), F.array(child).alias("children"))
    e = table(spark, sf_dir, "events").select("event_id", filter_steps(F.array(step), F.array(F.lit("name"))).alias("s"))
    return e.select("event_id", F.array_join(F.transform("s", lambda s: F.concat(s["target_field"], F.lit(":"), F.size(s["children"]).cast("string"))), ",").alias("kept"))


@query("export_selector", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 're')")
def export_selector(spark, sf_dir):
    from weftline.operators.labeling import export_selected

    return table(spark, sf_dir, "part").where(export_selected(F.col("p_name"), F.array(F.lit("x.RE")))).select("p_partkey")


@query("nested_upsert", "SELECT coalesce(s.s_suppkey, e.s_suppkey) AS line, CASE WHEN s.s_suppkey IS NULL OR (s.s_suppkey % 3 > 0 AND e.s_suppkey IS NOT NULL) THEN 'in.a' || CAST(coalesce(s.s_suppkey, e.s_suppkey) % 5 AS VARCHAR) WHEN s.s_suppkey % 3 = 0 THEN 'old.a' || CAST(s.s_suppkey % 5 AS VARCHAR) ELSE 'a' || CAST(s.s_suppkey % 5 AS VARCHAR) END AS target_field FROM (SELECT * FROM supplier WHERE s_nationkey > 3) s FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 2000) e ON s.s_suppkey = e.s_suppkey")
def nested_upsert(spark, sf_dir):
    from weftline.operators.labeling import nested_upsert as run

    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.concat(F.lit("a"), (F.col("s_suppkey") % 5).cast("string")).alias("leaf"))
    old = s.where("s_nationkey > 3").select(F.col("s_suppkey").alias("line"), F.concat(F.when(F.col("s_suppkey") % 3 == 0, "old.").otherwise(""), "leaf").alias("target_field"))
    return run(old, s.where("s_acctbal > 2000").select(F.col("s_suppkey").alias("line"), F.concat(F.lit("in."), "leaf").alias("target_field")))


@query("slice_routes", "SELECT 'x.f' || CAST(doc_id AS VARCHAR) AS field, CASE WHEN doc_id % 3 = 0 THEN 'exact' WHEN doc_id % 3 = 1 THEN 'leaf' ELSE 'suffix' END AS text FROM labels")
def slice_routes(spark, sf_dir):
    from weftline.operators.labeling import route

    l = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("leaf"))
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x."), "leaf")).when(F.col("doc_id") % 3 == 1, F.col("leaf")).otherwise(F.concat(F.lit("other."), "leaf"))
    text = F.when(F.col("doc_id") % 3 == 0, "exact").when(F.col("doc_id") % 3 == 1, "leaf").otherwise("suffix")
    return route(l.select(F.concat(F.lit("x."), "leaf").alias("field")), l.select(key.alias("field"), text.alias("text"))).select("field", "text")


@query("label_precedence", "SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'unmapped' WHEN lang = 'de' OR source = 'src0' OR lang <> 'fr' THEN 'mapped' ELSE 'unresolved' END AS state, CASE WHEN n_chars < 1000 THEN NULL WHEN lang = 'de' THEN 'verified' WHEN source = 'src0' THEN 'cache' WHEN lang <> 'fr' THEN 'model' END AS source FROM documents")
def label_precedence(spark, sf_dir):
    from weftline.operators.labeling import resolve_labels

    d = table(spark, sf_dir, "documents").withColumn("field", F.col("doc_id"))
    l = d.select("doc_id", "field", F.when(F.col("n_chars") < 1000, "unmapped").otherwise("mapped").alias("state"))
    some = lambda cond: d.where(cond).select("field", F.array(F.lit("READ")).alias("pipeline"))
    empty = d.where("lang = 'fr'").select("field", F.array().cast("array<string>").alias("pipeline"))
    return resolve_labels(l, some("lang = 'de'"), some("source = 'src0'"), some("lang <> 'fr'").unionByName(empty)).select("doc_id", "state", "source")


@query("label_statuses", "SELECT c_custkey AS mapper_id, CASE WHEN c_custkey % 9 = 0 THEN 'error' WHEN c_acctbal > 3000 THEN 'verified' WHEN c_mktsegment = 'BUILDING' THEN 'labeled' ELSE 'error' END AS status FROM customer")
def label_statuses(spark, sf_dir):
    """A batch run with answers for some mappers."""
    from weftline.operators.labeling import label_all

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mapper_id"), F.when(F.col("c_custkey") % 9 > 0, "f").alias("fingerprint"), "c_acctbal", "c_mktsegment")
    store = c.where("c_acctbal > 3000").select("mapper_id", F.lit("f").alias("fingerprint"))
    return label_all(c, store, c.where("c_mktsegment = 'BUILDING'"), True).select("mapper_id", "status")


@query("label_statuses_offline", "SELECT c_custkey AS mapper_id, CASE WHEN c_custkey % 9 = 0 THEN 'error' WHEN c_acctbal > 3000 THEN 'verified' ELSE 'needs-model' END AS status FROM customer")
def label_statuses_offline(spark, sf_dir):
    from weftline.operators.labeling import label_all

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mapper_id"), F.when(F.col("c_custkey") % 9 > 0, "f").alias("fingerprint"), "c_acctbal")
    return label_all(c, c.where("c_acctbal > 3000"), c.where("c_acctbal > 5000"), False).select("mapper_id", "status")
