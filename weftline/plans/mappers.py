"""Queries that run one operator over the rows of all mappers at once; a mapper is a supplier, its fields are named by the parts it sells.

Field names repeat, within a mapper by their last part and between mappers as a whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import audit, labeling, store
from weftline.plans.registry import query, table

BY = ["mapper_id"]
#: Lines of orders with their mapper, an order among them, and the kinds that their flag stands for.
ROWS_SQL = """rows AS (SELECT l_suppkey AS mapper_id, l_linenumber AS n, l_orderkey AS o, l_partkey % 40 AS f, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS pos,
  CASE l_returnflag WHEN 'A' THEN ['READ'] WHEN 'R' THEN ['READ', 'TRANSFORM'] ELSE ['CONSTANT'] END AS kinds FROM lineitem)"""
_LEAF = "lower(regexp_extract(target_field, '[^.]*$'))"


def text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def rows(spark, sf_dir):
    flag = F.col("l_returnflag")
    kinds = F.when(flag == "A", F.array(F.lit("read"))).when(flag == "R", F.array(F.lit("READ"), F.lit("transform"))).otherwise(F.array(F.lit("CONSTANT")))
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("mapper_id"), F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("o"), (F.col("l_partkey") % 40).alias("f"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10 + F.when(flag == "A", 0).when(flag == "R", 1).otherwise(2)).alias("pos"), kinds.alias("kinds"))


def versions_of(spark, sf_dir):
    """Fields (mapper_id, target_field, kinds, pos) of every mapper's previous and current version."""
    r = rows(spark, sf_dir).withColumn("target_field", F.concat(F.lit("p"), text(F.col("n") % 2), F.lit(".F"), text("f")))
    cols = ["mapper_id", "target_field", "kinds", "pos"]
    return r.where("n <= 3 and f < 30").select(*cols), r.where("n >= 3 and f > 5").select(*cols)


_VERSIONS_SQL = f"""{ROWS_SQL}, named AS (SELECT *, 'p' || CAST(n % 2 AS VARCHAR) || '.F' || CAST(f AS VARCHAR) AS target_field FROM rows),
old AS (SELECT *, {_LEAF} AS k FROM named WHERE n <= 3 AND f < 30), new AS (SELECT *, {_LEAF} AS k FROM named WHERE n >= 3 AND f > 5),
last AS (SELECT mapper_id, k, arg_max(kinds, pos) AS old_kinds FROM old GROUP BY mapper_id, k)"""


@query(
    "mapper_diffs",
    f"""WITH {_VERSIONS_SQL}
SELECT new.mapper_id, target_field, CASE WHEN last.k IS NULL THEN 'added' WHEN old_kinds = kinds THEN 'unchanged' ELSE 'kinds-changed' END AS change, coalesce(array_to_string(old_kinds, '>'), '') AS old_kinds, array_to_string(kinds, '>') AS new_kinds
FROM new LEFT JOIN last ON new.mapper_id = last.mapper_id AND new.k = last.k
UNION ALL SELECT mapper_id, target_field, 'removed', array_to_string(kinds, '>'), '' FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.mapper_id = old.mapper_id AND new.k = old.k)""",
)
def mapper_diffs(spark, sf_dir):
    """Every field of the current version and every one that is gone, of all mappers; several fields have one leaf."""
    told = store.diff(*versions_of(spark, sf_dir), BY)
    return told.select("mapper_id", "target_field", "change", *[F.coalesce(F.array_join(c, ">"), F.lit("")).alias(c) for c in ("old_kinds", "new_kinds")])


@query("mapper_goldens", f"WITH {_VERSIONS_SQL} SELECT n.mapper_id, outcome, count(*) AS n FROM (SELECT new.mapper_id, CASE WHEN last.k IS NULL THEN 'missing' WHEN old_kinds = kinds THEN 'matched' ELSE 'mismatched' END AS outcome FROM new LEFT JOIN last ON new.mapper_id = last.mapper_id AND new.k = last.k) n GROUP BY ALL")
def mapper_goldens(spark, sf_dir):
    """How the golden fields of all mappers compare with another version."""
    found, golden = versions_of(spark, sf_dir)
    return store.compare_golden(golden.drop("pos"), found, BY).groupBy("mapper_id", "outcome").agg(F.count("*").alias("n"))


@query(
    "mapper_checklists",
    f"""WITH {_VERSIONS_SQL}, fields AS (SELECT DISTINCT mapper_id, 'x.f' || CAST(f AS VARCHAR) AS field, 'f' || CAST(f AS VARCHAR) AS k FROM rows WHERE n = 4),
cache AS (SELECT DISTINCT mapper_id, k FROM new) SELECT f.mapper_id, field, CASE WHEN l.k IS NOT NULL THEN 'verified' WHEN c.k IS NOT NULL THEN 'cache' ELSE 'none' END AS available, coalesce(array_to_string(old_kinds, '>'), '') AS stored
FROM fields f LEFT JOIN last l ON f.mapper_id = l.mapper_id AND f.k = l.k LEFT JOIN cache c ON f.mapper_id = c.mapper_id AND f.k = c.k""",
)
def mapper_checklists(spark, sf_dir):
    """What is stored and cached for the fields of all mappers."""
    old, new = versions_of(spark, sf_dir)
    fields = rows(spark, sf_dir).where("n = 4").select("mapper_id", F.concat(F.lit("x.f"), text("f")).alias("field")).distinct()
    out = store.checklist_view(fields, old, new, BY)
    return out.select("mapper_id", "field", "available", F.coalesce(F.array_join(store.upper_kinds("stored"), ">"), F.lit("")).alias("stored"))


@query(
    "store_corrections",
    """WITH f AS (SELECT o_custkey AS mapper_id, o_orderkey, CAST(o_orderdate AS VARCHAR) AS day, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'user-corrected' ELSE 'pending-review' END AS status, o_orderpriority = '1-URGENT' AS urgent, o_orderkey % 2 = 0 AS even FROM orders)
SELECT mapper_id, 'x.F' || CAST(o_orderkey AS VARCHAR) AS target_field, CASE WHEN urgent THEN 'user-corrected' WHEN even AND status <> 'user-corrected' THEN 'pending-review' ELSE status END AS status,
  CASE WHEN urgent THEN 'judge' WHEN even AND status <> 'user-corrected' THEN 'model' ELSE 'before' END AS labeled_by,
  CASE WHEN urgent THEN 'wrong ' || CAST(o_orderkey AS VARCHAR) || '|line 3|2030-01-01' END AS correction, CASE WHEN urgent OR even AND status <> 'user-corrected' THEN '2030-01-01' ELSE left(day, 10) END AS updated_at FROM f""",
)
def store_corrections(spark, sf_dir):
    """New labels for every second field of all mappers, of which corrected ones stay, and then corrections with their record."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", store.CORRECTED).otherwise("pending-review")
    key = [F.col("o_custkey").alias("mapper_id"), F.lit("fp").alias("fingerprint"), F.concat(F.lit("x.F"), text("o_orderkey")).alias("target_field")]
    kept = o.select(*key, status.alias("status"), F.lit("before").alias("labeled_by"), F.substring(text("o_orderdate"), 1, 10).alias("updated_at"))
    labels = o.where("o_orderkey % 2 = 0").select(*key, F.lit("pending-review").alias("status"), F.lit("model").alias("labeled_by"))
    fixes = o.where("o_orderpriority = '1-URGENT'").select(*key, F.concat(F.lit("wrong "), text("o_orderkey")).alias("user_claim"), F.lit("line 3").alias("judge_evidence"))
    out = store.correct(store.promote(kept, labels, "2030-01-01"), fixes, "2030-01-01")
    record = F.when(F.col("correction").isNotNull(), F.concat_ws("|", "correction.user_claim", "correction.judge_evidence", "correction.corrected_at"))
    return out.select("mapper_id", "target_field", "status", "labeled_by", record.alias("correction"), "updated_at")


_TASKS_SQL = f"""{ROWS_SQL},
tasks AS (SELECT mapper_id, field, min(pos) AS pos, count(DISTINCT o % 7) AS depth FROM (SELECT *, CASE n WHEN 1 THEN 'a.F' WHEN 2 THEN 'x.a.f' WHEN 3 THEN 'f' ELSE 'A.f' END || CAST(f AS VARCHAR) AS field FROM rows WHERE n <= 4 AND f % 4 <> n - 1) GROUP BY mapper_id, field),
fields AS (SELECT DISTINCT mapper_id, CASE n WHEN 5 THEN 'f' WHEN 6 THEN 'q.a.F' ELSE 'A.F' END || CAST(f AS VARCHAR) AS field, f % 3 AS steps FROM rows WHERE n >= 5),
names AS (SELECT mapper_id, lower(field) AS name, min(pos) AS first, arg_max(depth, pos) AS depth FROM tasks GROUP BY ALL)"""


@query(
    "mapper_smells",
    f"""WITH {_TASKS_SQL}, met AS (
  SELECT f.mapper_id, field, steps, depth, name = lower(field) AS same, first FROM fields f JOIN names t ON f.mapper_id = t.mapper_id AND (name = lower(field) OR ends_with(lower(field), '.' || name) OR ends_with(name, '.' || lower(regexp_extract(field, '[^.]*$')))))
SELECT * FROM (SELECT mapper_id, field, CAST(steps AS INTEGER) AS steps, arg_min(depth, {{'other': NOT same, 'first': first}}) AS closure_depth FROM met GROUP BY ALL) WHERE closure_depth >= 2 AND steps BETWEEN 1 AND 2""",
)
def mapper_smells(spark, sf_dir):
    """Short pipelines of deep closures; a field's task is that of its name, in any case, or of the first ending."""
    r = rows(spark, sf_dir)
    name = lambda *options: F.concat(F.coalesce(*[F.when(F.col("n") == n, o) for n, o in options[:-1]], F.lit(options[-1])), text("f"))
    named = r.where("n <= 4 and f % 4 <> n - 1").withColumn("field", name((1, "a.F"), (2, "x.a.f"), (3, "f"), "A.f"))
    tasks = named.groupBy("mapper_id", "field").agg(F.min("pos").alias("pos"))
    closures = named.select("mapper_id", "field", (F.col("o") % 7).alias("helper"))
    pipelines = r.where("n >= 5").select("mapper_id", name((5, "f"), (6, "q.a.F"), "A.F").alias("field"), F.array_repeat(F.lit(1), (F.col("f") % 3).cast("int")).alias("pipeline")).distinct()
    return audit.smells(closures, pipelines, 2, 2, BY, tasks)


_STEPS_SQL = f"""{ROWS_SQL},
steps AS (SELECT mapper_id, 'f' || CAST(f AS VARCHAR) AS field, n, o, f, kinds[-1] AS kind FROM rows),
bad AS (SELECT mapper_id, count(*) AS bad FROM steps WHERE kind = 'READ' AND o % 3 = 0 AND NOT (f % 5 = 0 AND mapper_id % 2 = 0) OR kind = 'TRANSFORM' AND o % 2 = 0 OR kind = 'CONSTANT' AND o % 4 = 0 GROUP BY mapper_id)"""


@query(
    "mapper_scores",
    f"""WITH {_STEPS_SQL}, each AS (SELECT mapper_id, count(*) AS steps, count(DISTINCT field) AS mapped, count(DISTINCT CASE WHEN f % 3 > 0 THEN field END) AS sliced, count(*) FILTER (WHERE n = 7) AS raw FROM steps GROUP BY mapper_id)
SELECT s_suppkey AS mapper_id, round(least(1.0::DOUBLE, coalesce(mapped, 0) / 30.0::DOUBLE), 4) AS coverage, coalesce(round(1 - coalesce(bad, 0) / steps::DOUBLE, 4), 1) AS grounding, coalesce(round(1 - raw / steps::DOUBLE, 4), 1) AS specificity, coalesce(round(sliced / mapped::DOUBLE, 4), 1) AS provenance
FROM supplier LEFT JOIN each e ON s_suppkey = e.mapper_id LEFT JOIN bad b ON s_suppkey = b.mapper_id""",
)
def mapper_scores(spark, sf_dir):
    """The scores of all mappers: reads of names that the slice or the schema has, transforms and constants that the slice shows, or not."""
    r = rows(spark, sf_dir).withColumn("field", F.concat(F.lit("f"), text("f"))).withColumn("kind", F.upper(F.element_at("kinds", -1)))
    null = F.lit(None).cast("string")
    steps = r.select("mapper_id", "field", "pos", "kind", F.when(F.col("kind") == "READ", F.when(F.col("o") % 3 > 0, "in.seen").otherwise(F.concat(F.lit("in.gone"), text("f")))).otherwise(null).alias("source_field"), F.when(F.col("kind") == "TRANSFORM", F.when(F.col("o") % 2 > 0, "multiply").otherwise("trim")).alias("op"), F.when(F.col("kind") == "CONSTANT", F.when(F.col("o") % 4 > 0, "360").otherwise("361")).alias("value"))
    slices = r.select("mapper_id", "field", F.lit("t.setX(in.getSeen() * 360)").alias("text")).distinct()
    paths = r.where("f % 5 = 0 and mapper_id % 2 = 0").select("mapper_id", F.concat(F.lit("a.b.gone"), text("f")).alias("path"))
    pipelines = r.groupBy("mapper_id", "field").agg(F.collect_list(F.struct(F.when(F.col("n") == 7, "RAW").otherwise(F.col("kind")).alias("kind"))).alias("pipeline"))
    declared = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mapper_id"), F.lit(30).alias("declared"))
    return audit.scores(pipelines, declared, audit.ungrounded(steps, slices, paths, BY), slices.where("cast(substr(field, 2) as int) % 3 > 0"), BY)


@query(
    "mapper_provenance",
    f"""WITH {_STEPS_SQL} SELECT mapper_id, count(*) AS mapped, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM rows r WHERE r.mapper_id = d.mapper_id AND r.f = d.f AND n > 5)) AS with_slice,
  round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM rows r WHERE r.mapper_id = d.mapper_id AND r.f = d.f AND n > 5)) / count(*)::DOUBLE, 4) AS provenance FROM (SELECT DISTINCT mapper_id, f FROM steps) d GROUP BY mapper_id""",
)
def mapper_provenance(spark, sf_dir):
    r = rows(spark, sf_dir).withColumnRenamed("f", "field")
    return audit.provenance(r.select("mapper_id", "field").distinct(), r.where("n > 5"), BY)


@query(
    "mapper_claims",
    """WITH claims AS (SELECT l_suppkey AS mapper_id, l_orderkey AS o, l_linenumber AS n, 'F' || CAST(l_partkey % 40 AS VARCHAR) AS field, l_partkey % 40 AS f FROM lineitem),
judged AS (SELECT *, CASE WHEN f >= 35 OR (f + mapper_id) % 7 = 0 THEN 'unknown field' WHEN (f + mapper_id) % 2 = 0 THEN 'not unmapped' WHEN n % 4 = 0 OR n % 4 = 1 AND o % 5 > 3 OR n % 4 = 2 THEN 'no citation' ELSE '' END AS dropped FROM claims)
SELECT mapper_id, dropped, count(*) AS n FROM judged GROUP BY ALL""",
)
def mapper_claims(spark, sf_dir):
    """Claims on fields of all mappers: with a line of the text, half a line, a line beyond it and no quotation, or a quotation and any line."""
    l = table(spark, sf_dir, "lineitem")
    field, kind = F.concat(F.lit("F"), text(F.col("l_partkey") % 40)), F.col("l_linenumber") % 4
    line = F.when(kind == 0, "1.5").when(kind == 1, text(F.col("l_orderkey") % 5 + 1)).when(kind == 2, "99").otherwise("98.0")
    said = F.when(kind == 3, "as in `setX(1);`, surely").otherwise("it writes")
    claims = l.select(F.col("l_suppkey").alias("mapper_id"), field.alias("field"), line.alias("line"), said.alias("evidence"), F.lit("a\nb\nt.setX(1);\n").alias("text"))
    f = l.select(F.col("l_suppkey").alias("mapper_id"), (F.col("l_partkey") % 40).alias("f")).distinct().where("f < 35 and (f + mapper_id) % 7 > 0")
    check = f.select("mapper_id", F.concat(F.lit("f"), text("f")).alias("field"), F.when((F.col("f") + F.col("mapper_id")) % 2 == 0, "mapped").otherwise("unmapped").alias("state"))
    return audit.cross_check(claims, check, F.col("text"), BY).groupBy("mapper_id", F.coalesce("dropped", F.lit("")).alias("dropped")).agg(F.count("*").alias("n"))


@query(
    "mapper_labels",
    f"""WITH {ROWS_SQL}, fields AS (SELECT DISTINCT mapper_id, f, CASE WHEN f % 5 = 0 THEN 'unmapped' ELSE 'mapped' END AS state FROM rows),
v AS (SELECT DISTINCT mapper_id, f FROM rows WHERE n = 1), c AS (SELECT DISTINCT mapper_id, f FROM rows WHERE n = 2), a AS (SELECT DISTINCT mapper_id, f FROM rows WHERE n = 3 AND f % 2 = 0),
told AS (SELECT x.mapper_id, x.f, state, CASE WHEN state = 'mapped' THEN CASE WHEN v.f IS NOT NULL THEN 'verified' WHEN c.f IS NOT NULL THEN 'cache' WHEN a.f IS NOT NULL THEN 'model' END END AS source
  FROM fields x LEFT JOIN v ON x.mapper_id = v.mapper_id AND x.f = v.f LEFT JOIN c ON x.mapper_id = c.mapper_id AND x.f = c.f LEFT JOIN a ON x.mapper_id = a.mapper_id AND x.f = a.f)
SELECT mapper_id, 'f' || CAST(f AS VARCHAR) AS field, CASE WHEN state = 'mapped' AND source IS NULL THEN 'unresolved' ELSE state END AS state, source, source || CAST(mapper_id AS VARCHAR) AS first FROM told""",
)
def mapper_labels(spark, sf_dir):
    """Where the labels of all mappers' fields are from; an answer that is empty counts as none."""
    r = rows(spark, sf_dir).withColumn("field", F.concat(F.lit("f"), text("f")))
    side = lambda n, name, rest="true": r.where(F.col("n") == n).select("mapper_id", "field", F.when(F.expr(rest), F.array(F.concat(F.lit(name), text("mapper_id")))).otherwise(F.array().cast("array<string>")).alias("pipeline")).distinct()
    fields = r.select("mapper_id", "field", F.when(F.col("f") % 5 == 0, "unmapped").otherwise("mapped").alias("state")).distinct()
    out = labeling.resolve_labels(fields, side(1, "verified"), side(2, "cache"), side(3, "model", "f % 2 = 0"), BY)
    return out.select("mapper_id", "field", "state", "source", F.get("pipeline", F.lit(0)).alias("first"))


@query(
    "mapper_routes",
    f"""WITH {ROWS_SQL}, slices AS (SELECT DISTINCT mapper_id, CASE n WHEN 1 THEN 'a.F' WHEN 2 THEN 'f' ELSE 'b.F' END || CAST(f AS VARCHAR) AS key, f FROM rows WHERE n <= 3 AND f % 5 <> n),
fields AS (SELECT DISTINCT mapper_id, CASE n % 2 WHEN 0 THEN 'a.F' ELSE 'z.F' END || CAST(f AS VARCHAR) AS field, f FROM rows WHERE n >= 4)
SELECT x.mapper_id, field, coalesce(max(key) FILTER (WHERE key = field), max(key) FILTER (WHERE key = 'f' || CAST(x.f AS VARCHAR)), min(key)) AS text FROM fields x LEFT JOIN slices s ON x.mapper_id = s.mapper_id AND x.f = s.f GROUP BY x.mapper_id, field""",
)
def mapper_routes(spark, sf_dir):
    """The slice of every field of all mappers: of its key, its leaf or a key that ends so."""
    r = rows(spark, sf_dir)
    name = lambda kind: F.concat(kind, text("f"))
    slices = r.where("n <= 3 and f % 5 <> n").select("mapper_id", name(F.when(F.col("n") == 1, "a.F").when(F.col("n") == 2, "f").otherwise("b.F")).alias("field")).distinct()
    fields = r.where("n >= 4").select("mapper_id", name(F.when(F.col("n") % 2 == 0, "a.F").otherwise("z.F")).alias("field")).distinct()
    return labeling.route(fields, slices.withColumn("text", F.col("field")), BY)


@query(
    "mapper_findings",
    f"""WITH {ROWS_SQL}, each AS (SELECT mapper_id, f, min(pos) AS first, max(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS one, max(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS two FROM rows GROUP BY ALL)
SELECT mapper_id, 'discovered' AS kind, first AS num FROM each
UNION ALL SELECT mapper_id, 'diverging', f FROM each WHERE one = 1 AND (mapper_id + f) % 3 = 0
UNION ALL SELECT mapper_id, 'missing step', f FROM each WHERE two = 1 AND (mapper_id + f) % 2 = 0""",
)
def mapper_findings(spark, sf_dir):
    """Discovered fields, fields of two readings that differ, and missing steps that a critic cites rightly, of all mappers."""
    r = rows(spark, sf_dir)
    claims = r.select("mapper_id", F.concat(F.when(F.col("n") % 2 == 0, "a.setF").otherwise("f"), text("f")).alias("field"), "pos")
    found = labeling.discovered(claims, by=BY).select("mapper_id", F.lit("discovered").alias("kind"), F.col("pos").alias("num"))
    one = r.where("n = 1").select("mapper_id", F.col("f").alias("field")).distinct()
    sign = lambda odd: F.array(F.when(odd, "READ:b").otherwise("READ:a"))
    differ = labeling.diverging(one.withColumn("signatures", sign(F.lit(False))), one.withColumn("signatures", sign((F.col("mapper_id") + F.col("field")) % 3 == 0)), BY)
    two = r.where("n = 2").select("mapper_id", F.col("f").alias("field")).distinct()
    slices = two.withColumn("text", F.concat(F.lit("t.set"), text("field"), F.lit("(s.get"), text("mapper_id"), F.lit("());")))
    said = two.withColumn("evidence", F.concat(F.lit("`t.set"), text("field"), F.lit("(s.get"), text(F.col("mapper_id") + (F.col("mapper_id") + F.col("field")) % 2), F.lit("());`")))
    cited = labeling.critic_findings(said, slices, BY)
    rest = differ.select("mapper_id", F.lit("diverging").alias("kind"), F.col("field").alias("num")).unionByName(cited.select("mapper_id", F.lit("missing step").alias("kind"), F.col("field").alias("num")))
    return found.unionByName(rest)


@query(
    "label_rounds",
    f"""WITH {ROWS_SQL}, each AS (SELECT mapper_id, f, n, min(o) AS o FROM rows GROUP BY ALL),
tasks AS (SELECT DISTINCT mapper_id, f, CASE f % 4 WHEN 0 THEN 'mapped' WHEN 3 THEN 'unmapped' ELSE 'unresolved' END AS state FROM rows WHERE f % 4 < 3),
asked AS (SELECT t.*, n - 1 AS attempt, o % 2 = 0 AS known, o % 3 > 0 AS steps FROM tasks t JOIN each e ON t.mapper_id = e.mapper_id AND t.f = e.f WHERE n <= CASE WHEN state = 'unresolved' THEN 3 ELSE 2 END),
said AS (SELECT mapper_id, f, min(attempt) FILTER (WHERE known AND steps) AS good, arg_max(known, attempt) AS last FROM asked GROUP BY ALL),
ends AS (SELECT mapper_id, f, min(n) FILTER (WHERE o % 2 = 1) AS n FROM each WHERE n >= 4 GROUP BY ALL),
tools AS (SELECT e.mapper_id, e.f, ends.n IS NOT NULL AS ended, count(*) FILTER (WHERE o % 2 = 0) AS calls, max(CASE WHEN e.n = ends.n THEN o END) AS o FROM each e JOIN ends ON e.mapper_id = ends.mapper_id AND e.f = ends.f WHERE e.n >= 4 AND (ends.n IS NULL OR e.n <= ends.n) GROUP BY ALL),
met AS (SELECT t.*, good, state = 'unresolved' AND NOT coalesce(good IS NOT NULL OR last, false) AS tried, coalesce(calls, 0) AS calls, coalesce(ended, false) AS ended, x.o FROM tasks t LEFT JOIN said s ON t.mapper_id = s.mapper_id AND t.f = s.f LEFT JOIN tools x ON t.mapper_id = x.mapper_id AND t.f = x.f),
told AS (SELECT *, tried AND ended AND o % 3 > 0 AS tool_ok FROM met)
SELECT mapper_id, f AS field, CASE WHEN source IS NULL THEN 'unresolved' ELSE 'mapped' END AS state, source, attempts, tool_calls, tool_ok FROM (
  SELECT *, CASE WHEN tool_ok AND o % 5 > 0 THEN 'tools' WHEN tool_ok OR good IS NULL THEN NULL WHEN state = 'mapped' AND good = 0 THEN 'slice' WHEN good = 0 THEN 'full source' ELSE 'escalation' END AS source,
    CAST(coalesce(good, CASE WHEN state = 'unresolved' THEN 2 ELSE 1 END) + 1 AS INTEGER) AS attempts, CASE WHEN tried THEN calls ELSE 0 END AS tool_calls FROM told)""",
)
def label_rounds(spark, sf_dir):
    """How the fields of all mappers are settled, with answers to the slice, to the full source, to two escalations and of tools."""
    each = rows(spark, sf_dir).groupBy("mapper_id", F.col("f").alias("field"), "n").agg(F.min("o").alias("o"))
    state = F.when(F.col("field") % 4 == 0, "mapped").when(F.col("field") % 4 == 3, "unmapped").otherwise("unresolved")
    some = lambda yes: F.when(yes, F.array(F.lit("READ"))).otherwise(F.array().cast("array<string>")).alias("pipeline")
    tasks = each.select("mapper_id", "field", state.alias("state")).distinct()
    answers = each.where("n <= 3").select("mapper_id", "field", (F.col("n") - 1).alias("attempt"), (F.col("o") % 2 == 0).alias("recognised"), some(F.col("o") % 3 > 0))
    tools = each.where("n >= 4").select("mapper_id", "field", (F.col("n") - 4).alias("round"), F.when(F.col("o") % 2 == 0, "search").alias("tool"), (F.col("o") % 3 > 0).alias("recognised"), some(F.col("o") % 5 > 0))
    return labeling.label_rounds(tasks, answers, tools, 2, BY).drop("pipeline")


@query("golden_seeds", "SELECT doc_id AS mapper_id, 'x.F' || CAST(k AS VARCHAR) AS target_field, CASE WHEN k = 0 THEN 'READ>WRITE' ELSE 'CONSTANT' END AS kinds, 'verified' AS status, 'fp' AS fingerprint FROM labels, (VALUES (0), (1)) t(k) WHERE k = 0 OR quality = 1")
def golden_seeds(spark, sf_dir):
    """Store rows that stand for the golden documents of all labels."""
    from weftline.sources import jobs

    one = lambda k, *kinds: F.struct(F.lit(f"x.F{k}").alias("target_field"), F.array(*map(F.lit, kinds)).alias("pipeline_kinds"))
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("mapper_id"), F.when(F.col("quality") == 1, F.array(one(0, "READ", "WRITE"), one(1, "CONSTANT"))).otherwise(F.array(one(0, "READ", "WRITE"))).alias("fields"))
    return jobs.seed_store(jobs.goldens(d), "fp", "2030").select("mapper_id", "target_field", F.array_join("kinds", ">").alias("kinds"), "status", "fingerprint")


@query(
    "derived_checklists",
    f"WITH {ROWS_SQL}, named AS (SELECT mapper_id, CASE n % 3 WHEN 0 THEN 'a.F' WHEN 1 THEN 'aF' ELSE 'f' END || CAST(f AS VARCHAR) AS field, o AS line FROM rows) SELECT mapper_id, arg_min(field, {{'line': line, 'field': field}}) AS field, 'mapped' AS state FROM named GROUP BY mapper_id, lower(replace(field, '.', ''))",
)
def derived_checklists(spark, sf_dir):
    """The checklists of all mappers from their writes alone: names that are alike without case and dots are one field, as its first write has it."""
    name = F.when(F.col("n") % 3 == 0, "a.F").when(F.col("n") % 3 == 1, "aF").otherwise("f")
    sites = rows(spark, sf_dir).select("mapper_id", F.concat(name, text("f")).alias("target_field"), F.col("o").alias("line"))
    return labeling.fallback_checklist(sites, BY).select("mapper_id", "field", "state")


@query(
    "whole_gate",
    "SELECT count(*) AS declared, count(*) FILTER (WHERE p_size % 3 = 0) AS mapped, count(*) FILTER (WHERE p_size % 3 = 1) AS unmapped, count(*) FILTER (WHERE p_size % 3 = 2) AS unresolved, CAST(round(100.0 * count(*) FILTER (WHERE p_size % 3 = 0) / count(*)) AS BIGINT) AS mapped_pct, count(*) FILTER (WHERE p_size % 3 = 2) = 0 AND (SELECT count(*) FROM supplier WHERE s_acctbal < 0) = 0 AS gate_passed FROM part",
)
def whole_gate(spark, sf_dir):
    """One gate over all fields, with orphan writes."""
    state = F.get(F.array(*map(F.lit, ["mapped", "unmapped", "unresolved"])), F.col("p_size") % 3)
    check = table(spark, sf_dir, "part").select(F.col("p_name").alias("field"), state.alias("state"))
    return audit.gate(check, table(spark, sf_dir, "supplier").where("s_acctbal < 0"), [])


@query("result_sources", f"WITH {ROWS_SQL} SELECT mapper_id, CASE WHEN sum(n % 2) > 0 AND sum(1 - n % 2) > 0 THEN 'mixed' WHEN sum(1 - n % 2) > 0 THEN 'cache' ELSE 'model' END AS source FROM rows WHERE o % 30 = mapper_id % 30 GROUP BY mapper_id")
def result_sources(spark, sf_dir):
    """Where each mapper's results are from, of what was labelled and what was cached."""
    from weftline.functions.steps import result_source

    n = rows(spark, sf_dir).where("o % 30 = mapper_id % 30").groupBy("mapper_id").agg(F.sum(F.col("n") % 2).alias("a"), F.sum(1 - F.col("n") % 2).alias("b"))
    return n.select("mapper_id", result_source(F.col("a"), F.col("b")).alias("source"))
