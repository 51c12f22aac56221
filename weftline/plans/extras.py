"""Queries of answers, jobs, caches, logs and what else stands around the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import names
from weftline.functions import steps as st
from weftline.functions import text as tx
from weftline.operators import audit, journal, labeling, pipeline
from weftline.plans.registry import query, table
from weftline.plans.texts import CITED_SQL, mappers
from weftline.sources import files, java, jobs, logs, schemas
from weftline.sources.tables import Workspace


def text_of(name: str) -> F.Column:
    return F.col(name).cast("string")


@query("provider_counters", "SELECT user_id AS run, count(*) AS calls, CAST(sum(event_id % 3) AS BIGINT) AS retries, CAST(sum(event_id % 11) AS BIGINT) AS prompt, CAST(sum(event_id % 7) AS BIGINT) AS completion, CAST(sum(event_id * 37 % 1009) AS BIGINT) AS latency_ms, CAST(quantile_disc(event_id * 37 % 1009, 0.95) AS DOUBLE) AS p95_latency_ms FROM events GROUP BY user_id")
def provider_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("run"), (F.col("event_id") % 3).alias("retries"), (F.col("event_id") % 11).alias("prompt"), (F.col("event_id") % 7).alias("completion"), (F.col("event_id") * 37 % 1009).alias("latency_ms"))
    return journal.provider_counters(calls, ["run"])


@query("field_answers", "SELECT event_id, event_type = 'click' AS recognised, CASE WHEN event_id % 2 = 0 THEN 't' || CAST(user_id AS VARCHAR) END AS target_field, CASE WHEN event_id % 3 > 0 THEN 'read:trim:' || CASE WHEN event_id % 3 = 1 THEN 'a b' ELSE '' END END AS steps FROM events")
def field_answers(spark, sf_dir):
    """Answers in fences or not, with lists of steps or something else, and target fields that are texts or numbers."""
    known = F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 4 == 0, "1").otherwise("true")).when(F.col("event_type") == "view", "null").otherwise("false")
    target = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"t'), text_of("user_id"), F.lit('"'))).otherwise("5")
    said = F.when(F.col("event_id") % 3 == 1, " a b ").otherwise("  ")
    steps = F.when(F.col("event_id") % 3 == 0, '"none"').otherwise(F.concat(F.lit('[{"kind": "READ", "op": "Trim", "summary": "'), said, F.lit('"}]')))
    body = F.concat(F.lit('{"recognized": '), known, F.lit(', "targetField": '), target, F.lit(', "pipeline": '), steps, F.lit("}"))
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    a = table(spark, sf_dir, "events").select("event_id", tx.field_answer(raw).alias("a"))
    shown = F.array_join(F.transform("a.pipeline", lambda s: F.concat(s["kind"], F.lit(":"), s["op"], F.lit(":"), F.coalesce(s["summary"], F.lit("")))), ",")
    return a.select("event_id", "a.recognised", "a.target_field", shown.alias("steps"))


@query("judge_jobs", f"WITH {CITED_SQL} SELECT l.doc_id, 'f.Name' || CAST(l.doc_id AS VARCHAR) AS field, quality AS stored_steps, CASE WHEN toxic = 0 THEN 'confirmed' WHEN NOT cited THEN 'unverifiable' WHEN quality = 1 THEN 'corrected' ELSE 'invalid' END AS outcome FROM labels l JOIN cited c ON l.doc_id = c.doc_id")
def judge_jobs(spark, sf_dir):
    """Jobs made of claims, tasks, sources and stored pipelines, and the outcomes of their results."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = text_of("doc_id")
    step = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in (("kind", "READ"), ("source_field", None), ("condition", None), ("op", None), ("value", None))])
    claims = l.select(key.alias("mapper_id"), F.concat(F.lit("NAME"), key).alias("field"), F.lit("wrong").alias("claim"))
    tasks = l.select(key.alias("mapper_id"), F.concat(F.lit("f.Name"), key).alias("field"), F.lit("slice").alias("slice_text"))
    sources = d.select(key.alias("mapper_id"), F.lit("fp").alias("fingerprint"), F.col("text"))
    store = l.where("quality = 1").select(key.alias("mapper_id"), F.lit("fp").alias("fingerprint"), F.concat(F.lit("x.name"), key).alias("target_field"), F.array(step).alias("pipeline"))
    made = Workspace(spark).keep(jobs.export_judge(claims, tasks, sources, store))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see `"), F.substring("text", 5, 20), F.lit("`"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see line "), (F.col("doc_id") % 100).cast("string"))).otherwise("see `never there at all 123`")
    fix = F.when(F.col("quality") == 1, F.array(step)).otherwise(F.array().cast(store.schema["pipeline"].dataType))
    verdict = F.struct(F.when(F.col("toxic") == 1, "true").otherwise("no").alias("agree"), said.alias("evidence"), F.lit("r").alias("reason"), fix.alias("pipeline"))
    results = l.join(d, "doc_id").select(key.alias("mapper_id"), F.lit("fp").alias("fingerprint"), F.concat(F.lit("f.Name"), key).alias("field"), verdict.alias("verdict"))
    out, _ = jobs.import_judge(made, results)
    both = out.join(made.select("mapper_id", "field", "current_pipeline"), ["mapper_id", "field"])
    return both.select(F.col("mapper_id").cast("long").alias("doc_id"), "field", F.coalesce(F.size("current_pipeline"), F.lit(0)).alias("stored_steps"), "outcome")


@query("label_from_cache", "WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders), v AS (SELECT * FROM f WHERE n = 1) SELECT c_custkey AS mapper_id, CASE WHEN c_acctbal > 5000 THEN 'verified:now' WHEN v.n IS NOT NULL AND c_nationkey < 10 THEN 'older:' || CAST(v.o_orderkey AS VARCHAR) WHEN c_acctbal > 0 AND c_nationkey >= 10 THEN 'cache:here' END AS found FROM customer LEFT JOIN v ON c_custkey = o_custkey")
def label_from_cache(spark, sf_dir):
    """A field of every customer: verified, cached for the current fingerprint, or of the newest other one."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    own = c.select(F.col("c_custkey").alias("mapper_id"), F.lit("now").alias("fingerprint"), "c_acctbal", "c_nationkey", F.lit("f").alias("field"))
    verified = own.where("c_acctbal > 5000").select("mapper_id", "fingerprint", "field", F.array(F.lit("now")).alias("pipeline"))
    here = own.where("c_acctbal > 0 and c_nationkey >= 10").select("mapper_id", "fingerprint", "field", F.array(F.lit("here")).alias("pipeline"), F.lit("2000-01-01").cast("timestamp_ntz").alias("updated_at"))
    older = o.join(own.where("c_nationkey < 10").select("mapper_id"), F.col("o_custkey") == F.col("mapper_id")).select("mapper_id", F.lpad(text_of("o_orderkey"), 12, "0").alias("fingerprint"), F.lit("f").alias("field"), F.array(text_of("o_orderkey")).alias("pipeline"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    out = labeling.label_from_cache(own.select("mapper_id", "field"), verified, here.unionByName(older), own.select("mapper_id", "fingerprint"))
    return out.select("mapper_id", F.concat_ws(":", "source", F.get("pipeline", F.lit(0))).alias("found")).withColumn("found", F.nullif("found", F.lit("")))


@query("schema_documents", "SELECT CAST(s_suppkey AS VARCHAR) AS mapper_id, path, CASE path WHEN 'name' THEN 'string' ELSE 'integer' END AS type FROM supplier, (VALUES ('name'), ('size')) t(path)")
def schema_documents(spark, sf_dir):
    """Schema documents that are validated and saved, read again and flattened."""
    key = text_of("s_suppkey")
    child = lambda n, t: f'{{"id": "{n}", "name": "{n}", "type": "{t}"}}'
    side = f'{{"method": "manual", "root": {{"id": "r", "name": "root", "type": "object", "children": [{child("name", "string")}, {child("size", "integer")}]}}}}'
    doc = F.concat(F.lit('{"version": 1, "savedAt": "2024", "mapperId": "'), key, F.lit(f'", "source": {side}, "target": {side}}}'))
    path = f"{Workspace(spark).root}/schemas"
    schemas.save_documents(table(spark, sf_dir, "supplier").select(key.alias("mapper_id"), doc.alias("text")), path)
    return schemas.flat_schemas(schemas.load_documents(spark, path), "mapper_id", "text", "document").select("mapper_id", "path", "type")


@query("cache_list", "SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS key, CASE WHEN s_nationkey < 5 THEN 'new' ELSE s_name END AS field FROM supplier WHERE s_nationkey >= 5 UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'new' FROM nation WHERE n_nationkey < 5")
def cache_list(spark, sf_dir):
    """A cache whose rows are put by key, some keys put again, and listed."""
    c = files.Cache(spark, f"{Workspace(spark).root}/cache", "field", "field string")
    c.put(table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), text_of("s_nationkey")).alias("key"), F.col("s_name").alias("field")).coalesce(1))
    c.put(table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), text_of("n_nationkey")).alias("key"), F.lit("new").alias("field")).coalesce(1))
    return c.list().select("key", "field")


@query("resolve_sources", "SELECT c_custkey AS mapper_id, CASE WHEN c_nationkey < 10 THEN 'local' WHEN c_nationkey < 20 AND c_custkey % 2 = 0 THEN 'cache' ELSE 'remote' END AS found_in, CASE WHEN c_nationkey < 10 THEN 'a' WHEN c_nationkey < 20 AND c_custkey % 2 = 0 THEN 'b' || CAST(c_nationkey AS VARCHAR) END AS text FROM customer")
def resolve_sources(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = lambda k: F.concat(F.lit("src/"), text_of(k), F.lit(".java"))
    m = c.select(F.col("c_custkey").alias("mapper_id"), F.when(F.col("c_custkey") % 2 == 0, own("c_nationkey")).otherwise(F.when(F.col("c_nationkey") < 10, own("c_nationkey")).otherwise("gone.java")).alias("source_file"))
    local = n.where("n_nationkey < 10").select(own("n_nationkey").alias("path"), F.lit("a").alias("text"))
    cached = n.where("n_nationkey < 20").select(own("n_nationkey").alias("path"), F.lit("sha").alias("commit_sha"))
    trees = n.where("n_nationkey < 20").select(F.lit("sha").alias("commit_sha"), own("n_nationkey").alias("path"), F.concat(F.lit("b"), text_of("n_nationkey")).alias("text"))
    return files.resolve_sources(m, local, cached=cached, trees=trees).select("mapper_id", "found_in", "text")


@query("flatten_mapping", "SELECT user_id AS pipeline, 't' || CAST(event_id % 5 AS VARCHAR) AS target_field, CAST(row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) - 1 AS INTEGER) AS pos, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'v' END AS summary FROM events")
def flatten_mapping(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pipeline"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("target_field"), "event_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, " v ").otherwise(" ").alias("summary"))
    grouped = e.groupBy("pipeline", "target_field").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "kind", "summary"))), lambda s: F.struct(s["kind"].alias("kind"), s["summary"].alias("summary"))).alias("ops"))
    return pipeline.flatten_mapping(grouped).select("pipeline", "target_field", "pos", "kind", "summary")


@query("statement_offset", "SELECT doc_id, CASE WHEN length(text) >= 40 THEN CASE WHEN doc_id % 3 < 2 THEN position(replace(substr(text, 21, 20), chr(10), ' ') IN replace(text, chr(10), ' ')) - 1 END END AS at FROM documents")
def statement_offset(spark, sf_dir):
    """Where a piece of each text, its first line with another after it, or neither stands."""
    plain = F.replace("text", F.lit("\n"), F.lit(" "))
    piece = F.substring(plain, 21, 20)
    said = F.when(F.col("doc_id") % 3 == 0, piece).when(F.col("doc_id") % 3 == 1, F.concat(piece, F.lit("\nnot there"))).otherwise("\x01 nowhere")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.length("text") >= 40, tx.statement_offset(plain, said)).cast("long").alias("at"))


@query("smell_diagnostics", "SELECT 'step-smell ' || CAST(p_partkey AS VARCHAR) || ': ' || CAST(count(DISTINCT l_suppkey) AS VARCHAR) || ' helpers' AS text FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size % 4 BETWEEN 1 AND 2 GROUP BY p_partkey HAVING count(DISTINCT l_suppkey) >= 4")
def smell_diagnostics(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(text_of("l_partkey").alias("field"), F.col("l_suppkey").alias("helper"))
    p = table(spark, sf_dir, "part").select(text_of("p_partkey").alias("field"), F.array_repeat(F.lit(1), F.col("p_size") % 4).alias("pipeline"))
    found = audit.smells(c, p).withColumn("detail", F.concat(text_of("closure_depth"), F.lit(" helpers")))
    return audit.smell_diagnostics(found, [])


@query("accessor_fields", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN lower(event_type[1]) || event_type[2:] || 'X' END AS field FROM events")
def accessor_fields(spark, sf_dir):
    prefix = F.get(F.array(*map(F.lit, ["set", "get", "is", "has"])), (F.col("event_id") % 4).cast("int"))
    method = F.concat(prefix, names.capital(F.col("event_type")), F.lit("X"))
    return table(spark, sf_dir, "events").select("event_id", names.accessor_field(method).alias("field"))


@query("worktrees", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'C:/work/' ELSE '/home/w' END || CAST(s_nationkey AS VARCHAR) END AS worktree FROM supplier")
def worktrees(spark, sf_dir):
    root = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "C:\\work\\").otherwise("/home/w"), text_of("s_nationkey"))
    file = F.concat(F.lit("src/M"), text_of("s_suppkey"), F.lit(".java"))
    path = F.concat(root, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("\\src\\M"), text_of("s_suppkey"), F.lit(".java"))).otherwise(F.concat(F.lit("/"), file)))
    relative = F.when(F.col("s_suppkey") % 3 > 0, file).otherwise("src/Other.java")
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.infer_worktree(path, relative).alias("worktree"))


@query("step_divergence", "SELECT event_id, event_id % 3 > 0 AS diverges FROM events")
def step_divergence(spark, sf_dir):
    sign = lambda op: st.signature(F.col("event_type"), text_of("user_id"), F.lit(None).cast("string"), op, F.lit(None).cast("string"))
    a = F.array(sign(F.lit("trim")))
    b = F.when(F.col("event_id") % 3 == 0, F.array(sign(F.lit("trim")))).when(F.col("event_id") % 3 == 1, F.array(sign(F.lit("split")))).otherwise(F.array(sign(F.lit("trim")), sign(F.lit("trim"))))
    return table(spark, sf_dir, "events").select("event_id", st.diverge(a, b).alias("diverges"))


@query("constant_literals", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN '\"' || event_type ELSE event_type END AS value FROM events")
def constant_literals(spark, sf_dir):
    quoted = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" '"), "event_type", F.lit("' "))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("  "), "event_type")).otherwise(F.concat(F.lit('"'), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", st.unquoted(quoted).alias("value"))


@query("diagnostic_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id")
def diagnostic_counts(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.concat("event_type", F.lit(" at "), text_of("event_id"))).alias("d"))
    return d.select("user_id", labeling.count_diagnostics(F.col("d"), "error").cast("long").alias("errors"))


@query("step_provenance", "SELECT doc_id, CASE WHEN quality = 1 THEN 'cache' WHEN toxic = 1 THEN 'tool-loop' WHEN doc_id % 2 = 0 THEN 'escalation' ELSE 'slice' END AS provenance FROM labels")
def step_provenance(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", st.provenance(F.col("quality") == 1, F.col("toxic") == 1, F.col("doc_id") % 2 == 0).alias("provenance"))


@query("meta_without_code", "SELECT event_id, 'kind,value' AS keys FROM events")
def meta_without_code(spark, sf_dir):
    meta = F.create_map(F.lit("code"), text_of("event_id"), F.lit("kind"), "event_type", F.lit("value"), text_of("user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(st.without_code(meta))), ",").alias("keys"))


@query("merged_field_lists", "SELECT user_id, string_agg(DISTINCT x, ',' ORDER BY x) AS fields FROM (SELECT user_id, event_type AS x FROM events UNION ALL SELECT user_id, 'k' || CAST(event_id % 3 AS VARCHAR) FROM events) GROUP BY user_id")
def merged_field_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))).alias("b"))
    return e.select("user_id", F.array_join(pipeline.merge_field_lists(F.col("a"), F.col("b")), ",").alias("fields"))


@query("discovered_fields", "SELECT min(event_id) AS pos, 0.6::DOUBLE AS confidence FROM (SELECT event_id, regexp_replace(lower(event_type) || 'f' || CAST(user_id AS VARCHAR), '^(set|get|is)', '') AS k FROM events) GROUP BY k")
def discovered_fields(spark, sf_dir):
    prefix = F.get(F.array(*map(F.lit, ["set", "get", "is", ""])), (F.col("event_id") % 4).cast("int"))
    c = table(spark, sf_dir, "events").select(F.concat(F.lit("a."), prefix, names.capital(F.col("event_type")), F.lit("F"), text_of("user_id")).alias("field"), F.col("event_id").alias("pos"))
    return labeling.discovered(c).select("pos", "confidence")


@query("critic_findings", f"WITH {CITED_SQL} SELECT l.doc_id FROM labels l JOIN cited c ON l.doc_id = c.doc_id WHERE cited")
def critic_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see `"), F.substring("text", 5, 20), F.lit("`"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see line "), (F.col("doc_id") % 100).cast("string"))).otherwise("see `never there at all 123`")
    claims = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", F.col("doc_id").alias("field"), said.alias("evidence"))
    return labeling.critic_findings(claims, d.select(F.col("doc_id").alias("field"), "text")).select("doc_id")


@query("diverging_fields", "SELECT p_partkey AS field FROM part WHERE p_size % 3 = 0")
def diverging_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("field"), F.array("p_type", "p_brand").alias("signatures"))
    b = p.select(F.col("p_partkey").alias("field"), F.when(F.col("p_size") % 3 == 0, F.array("p_type")).otherwise(F.array("p_type", "p_brand")).alias("signatures"))
    return labeling.diverging(a, b)


@query("journal_log", "SELECT user_id AS mapper_id, count(*) AS runs, CAST(sum(event_id) AS BIGINT) AS declared FROM events GROUP BY user_id")
def journal_log(spark, sf_dir):
    """Runs that are appended to a log of JSON lines in two turns and read again with the log's schema."""
    path = f"{Workspace(spark).root}/journal"
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), text_of("user_id").alias("mapper_id"), F.col("event_id").alias("declared"), (F.col("event_id") % 2).alias("turn"))
    for turn in (0, 1):
        logs.append(e.where(F.col("turn") == turn).drop("turn"), path)
    return logs.read(spark, path).groupBy(F.col("mapper_id").cast("long").alias("mapper_id")).agg(F.count("*").alias("runs"), F.sum("declared").alias("declared"))


@query("trace_lines", "SELECT CAST(user_id AS VARCHAR) AS mapper_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, CAST(row_number() OVER w AS VARCHAR) || '. ' || event_type || ' ' || CAST(event_id AS VARCHAR) || ' -> ' || substr(repeat(props, 30), 1, 120) AS text FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def trace_lines(spark, sf_dir):
    step = F.struct("event_id", F.col("event_type").alias("tool"), text_of("event_id").alias("input"), F.repeat("props", F.lit(30)).alias("output_preview"))
    e = table(spark, sf_dir, "events").groupBy(text_of("user_id").alias("mapper_id")).agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s.dropFields("event_id")).alias("steps"))
    trace = logs.preview(e.withColumn("field", F.lit("f")))
    return logs.format_trace(trace).select("mapper_id", "pos", "text")


@query("offline_jobs", "SELECT o_custkey AS mapper_id, count(*) FILTER (WHERE o_orderstatus <> 'P') AS asked, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS answered FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus <> 'P') > 0")
def offline_jobs(spark, sf_dir):
    """Label jobs of every customer, and what results of theirs, some unrecognised, answer and leave open."""
    o = table(spark, sf_dir, "orders").withColumn("mapper_id", text_of("o_custkey")).withColumn("field", F.concat(F.lit("F"), text_of("o_orderkey")))
    state = F.when(F.col("o_orderstatus") == "P", "unmapped").when(F.col("o_orderstatus") == "F", "mapped").otherwise("unresolved")
    prints = o.select("mapper_id").distinct().withColumn("fingerprint", F.lit("fp"))
    job = Workspace(spark).keep(jobs.export_job(o.select("mapper_id", "field", state.alias("state"), F.lit("s").alias("slice")), prints))
    step = F.struct(*[F.lit("READ" if k == "kind" else None).cast("string").alias(k) for k in ("kind", "source_field", "condition", "op", "value")])
    answer = F.struct(F.lower("field").alias("field"), (F.col("o_orderkey") % 2 == 0).alias("recognised"), F.array(step).alias("pipeline"))
    results = o.where("o_orderstatus = 'F'").groupBy("mapper_id").agg(F.collect_list(answer).alias("results")).withColumn("fingerprint", F.lit("fp"))
    found, open_ = jobs.import_results(job, results)
    both = found.select("mapper_id", F.lit(1).alias("n")).unionByName(open_.select("mapper_id", F.lit(0).alias("n")))
    return both.groupBy(F.col("mapper_id").cast("long").alias("mapper_id")).agg(F.count("*").alias("asked"), F.sum("n").alias("answered"))


@query("scrubbed_lines", "SELECT CAST(s_suppkey AS VARCHAR) AS path, 7 AS line, CASE WHEN s_suppkey % 2 = 0 THEN 't.setName(clean(s.getName()));' ELSE 't.setName(s.getName());' END AS bare FROM supplier")
def scrubbed_lines(spark, sf_dir):
    """A line of every mapper's source without its comment."""
    found = java.scan(mappers(spark, sf_dir), "lines").where(F.contains("text", F.lit("setName")))
    return found.select("path", "line", F.trim("bare").alias("bare"))


@query("accessor_only_fields", "SELECT CAST(s_suppkey AS VARCHAR) AS path, 'kept' AS name, 'String' AS type FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR), NULL FROM supplier")
def accessor_only_fields(spark, sf_dir):
    """Fields that only a getter or setter of the target shows, beside declared ones."""
    s = table(spark, sf_dir, "supplier")
    code = F.concat(F.lit("class Target { private String kept; public String getKept() { return kept; } void setN"), text_of("s_nationkey"), F.lit("(String x) { } }"))
    source = s.select(text_of("s_suppkey").alias("path"), code.alias("text"))
    return java.scan(source, "target_fields", "Target").select("path", "name", "type")
