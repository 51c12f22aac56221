"""Queries of column functions: names, steps, operations, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import hashing, names, ops
from weftline.functions import steps as st
from weftline.plans.registry import KIND_SQL, query, table

NORM = "lower(regexp_replace({}, '[^a-zA-Z0-9]', '', 'g'))"
LEAF = "regexp_replace(list_last(string_split({}, '.')), '\\[\\]$', '')"
PATH = "'order.' || replace(c_name, '#', '.get') || CASE WHEN c_custkey % 4 = 0 THEN '[]' ELSE '' END"


def paths(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("order."), F.replace("c_name", F.lit("#"), F.lit(".get")), F.when(F.col("c_custkey") % 4 == 0, "[]").otherwise(""))
    return c.select("c_custkey", path.alias("path"))


@query("names_norm", f"SELECT p_partkey, {NORM.format('p_name')} AS norm FROM part")
def names_norm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.norm(F.col("p_name")).alias("norm"))


@query("names_leaf_bean", f"SELECT c_custkey, {LEAF.format(PATH)} AS leaf, regexp_replace({NORM.format(LEAF.format(PATH))}, '^(set|get|is)', '') AS bean FROM customer")
def names_leaf_bean(spark, sf_dir):
    return paths(spark, sf_dir).select("c_custkey", names.leaf(F.col("path")).alias("leaf"), names.bean_leaf(F.col("path")).alias("bean"))


@query(
    "selector_match",
    f"""
WITH n AS (SELECT p_partkey, {NORM.format("p_type")} AS t FROM part)
SELECT p_partkey, t LIKE '%steel' OR t LIKE '%tin' OR 'mediumbrass' LIKE '%' || t OR 'large tin' = t AS hit
FROM (SELECT p_partkey, t FROM n WHERE length(t) > 0)""",
)
def selector_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.matches_selectors(F.col("p_type"), F.array(F.lit("STEEL"), F.lit("tin"), F.lit("medium brass"))).alias("hit"))


FQCN = "'com.acme.n' || CAST(s_nationkey AS VARCHAR) || '.Supplier' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 3 = 0 THEN '$Inner' ELSE '' END"


@query("fqcn_split", f"SELECT s_suppkey, regexp_extract(f, '([^.$]*)$', 1) AS simple, 'com/acme/n' || CAST(s_nationkey AS VARCHAR) AS package_path, 'Supplier' || CAST(s_suppkey AS VARCHAR) AS outer_class FROM (SELECT *, {FQCN} AS f FROM supplier)")
def fqcn_split(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    f = F.concat(F.lit("com.acme.n"), F.col("s_nationkey").cast("string"), F.lit(".Supplier"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "$Inner").otherwise(""))
    return s.select("s_suppkey", names.simple_type_name(f).alias("simple"), names.package_path(f).alias("package_path"), names.outer_class(f).alias("outer_class"))


@query("scope_filter", r"SELECT page_id FROM pages WHERE regexp_matches(regexp_extract(url, '^https?://([^?]*)', 1), '^[^/]*example\.(com|org)/(.*/)?[^/]*[0-9]$')")
def scope_filter(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://([^?]*)", 1)
    return table(spark, sf_dir, "pages").where(names.in_scope(path, ["*example.{com,org}/**/*" + str(d) for d in range(10)])).select("page_id")


@query(
    "kind_canonical",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'READ' WHEN event_type = 'click' THEN 'TRANSFORM' ELSE 'RAW' END AS kind,
  CASE WHEN event_type NOT IN ('view', 'click') THEN event_type END AS original_kind,
  CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'keepDigits' ELSE 'trim' END END AS op FROM events""",
)
def kind_canonical(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "view", " read ").when(F.col("event_type") == "click", "Transform").otherwise(F.col("event_type"))
    op = F.when(F.col("event_id") % 2 == 0, "Keep-Digits And Hyphen").otherwise("trim")
    c = st.canonical(raw, F.lit("a"), F.lit("b"), op, F.lit("c"))
    return e.select("event_id", c.alias("c")).select("event_id", "c.kind", "c.original_kind", "c.op")


@query("step_signature", f"SELECT event_id, concat_ws('|', {KIND_SQL}, CASE WHEN event_id % 2 = 0 THEN 's' || CAST(user_id AS VARCHAR) END, CASE WHEN event_type = 'click' THEN 'trim' END, props) AS signature FROM events")
def step_signature(spark, sf_dir):
    from weftline.plans.registry import KIND

    kinds = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])
    e = table(spark, sf_dir, "events")
    sig = st.signature(F.lower(kinds[F.col("event_type")]), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))), F.lit(None).cast("string"), F.when(F.col("event_type") == "click", "trim"), F.col("props"))
    return e.select("event_id", sig.alias("signature"))


RAW_PARAM = "CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN '' WHEN 2 THEN ' ' || CAST(event_id AS VARCHAR) || ' ' WHEN 3 THEN CAST(user_id AS VARCHAR) || '.5' ELSE 'x' || CAST(event_id AS VARCHAR) END"


@query("param_coerce", f"SELECT event_id, CASE WHEN try_cast(p AS DOUBLE) IS NULL THEN p END AS text, try_cast(p AS DOUBLE) AS number FROM (SELECT event_id, {RAW_PARAM} AS p FROM events)")
def param_coerce(spark, sf_dir):
    raw = F.expr(RAW_PARAM.replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "events").select("event_id", st.view_param(raw).alias("p")).select("event_id", "p.text", "p.number")


@query("ops_trim_case", r"SELECT p_partkey, regexp_replace(chr(9) || ' ' || p_name || chr(10), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS trimmed, upper(p_name) AS upper, lower(p_type) AS lower FROM part")
def ops_trim_case(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", ops.trim(F.concat(F.lit("\t "), "p_name", F.lit("\n"))).alias("trimmed"), ops.OPS["uppercase"](F.col("p_name"), None).alias("upper"), ops.OPS["lowercase"](F.col("p_type"), None).alias("lower"))


@query("ops_split_take", r"SELECT p_partkey, len(string_split_regex(p_name, '\s+')) AS n_parts, string_split_regex(p_name, '\s+')[1] AS first, list_last(string_split_regex(p_name, '\s+')) AS last, string_split_regex(p_name, '\s+')[2] AS second FROM part")
def ops_split_take(spark, sf_dir):
    parts = ops.split(F.concat("p_name", F.lit("  ")), r"\s+")
    p = table(spark, sf_dir, "part").select("p_partkey", parts.alias("a"))
    return p.select("p_partkey", F.size("a").cast("long").alias("n_parts"), ops.take_first(F.col("a")).alias("first"), ops.take_last(F.col("a")).alias("last"), ops.take_index(F.col("a"), 1).alias("second"))


@query("ops_letters_digits", r"SELECT c_custkey, regexp_replace(c_name, '[^\p{L}]', '', 'g') AS letters, regexp_replace(c_name || '-7', '[^\p{Nd}-]', '', 'g') AS digits FROM customer")
def ops_letters_digits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ops.letters_only(F.col("c_name")).alias("letters"), ops.keep_digits(F.concat("c_name", F.lit("-7"))).alias("digits"))


@query("ops_arith", "SELECT c_custkey, CAST(trunc(c_acctbal * 1000.0::DOUBLE) AS BIGINT) AS grams, c_acctbal + 1.5::DOUBLE AS added, c_acctbal - 2.0::DOUBLE AS subtracted, c_acctbal / 4.0::DOUBLE AS divided, CAST(NULL AS DOUBLE) AS by_zero FROM customer")
def ops_arith(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", ops.whole(ops.multiply(b, 1000.0)).alias("grams"), ops.add(b, 1.5).alias("added"), ops.subtract(b, 2.0).alias("subtracted"), ops.divide(b, 4.0).alias("divided"), ops.divide(b, 0.0).alias("by_zero"))


@query("ops_join_mask_round", "SELECT p_partkey, concat_ws(' ', p_brand, p_type) AS joined, repeat('*', least(4, length(p_name))) || substr(p_name, 5) AS masked, floor(p_retailprice) AS rounded FROM part")
def ops_join_mask_round(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ops.join(F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type")).alias("joined"), ops.mask(F.col("p_name")).alias("masked"), ops.round_to(F.floor("p_retailprice").cast("double"), 0).alias("rounded"))


@query(
    "filter_select_build",
    """SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'metal' WHEN p_size > 25 THEN 'large' ELSE 'other' END AS class,
  list_filter(string_split(p_name, ' '), lambda w: contains(w, 'e'))[1] AS first_e, list_last(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'e'))) AS last_e,
  len(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'e'))) AS n_e FROM part""",
)
def filter_select_build(spark, sf_dir):
    """An executed pipeline with two guarded constants and a default, and the three selections."""
    p = table(spark, sf_dir, "part")
    cols = {"type": F.col("p_type"), "size": F.col("p_size")}
    run = ops.compile_steps(
        [
            {"kind": "FILTER", "sourceField": "type", "condition": "contains STEEL"},
            {"kind": "CONSTANT", "meta": {"value": "metal"}},
            {"kind": "FILTER", "sourceField": "size", "condition": "greater than 25"},
            {"kind": "CONSTANT", "meta": {"value": "large"}},
            {"kind": "CONSTANT", "meta": {"value": "other"}},
            {"kind": "WRITE"},
        ],
        cols,
    )
    words, has_e = F.split("p_name", " "), lambda w: F.contains(w, F.lit("e"))
    return p.select("p_partkey", run.alias("class"), ops.select_match(words, has_e, "First match").alias("first_e"), ops.select_match(words, has_e, "Last match").alias("last_e"), F.size(ops.select_match(words, has_e, "All matches")).cast("long").alias("n_e"))


SEP = "chr(10) || '---' || chr(10)"


@query("fingerprint", f"SELECT p_partkey, sha256(p_type || {SEP} || p_name) AS store_fp, sha256('9' || {SEP} || p_brand || {SEP} || p_type || {SEP} || p_name) AS pipeline_fp, substr(sha256(p_name), 1, 12) AS source_sha, substr(sha256(p_name), 1, 40) AS content, substr(sha256(p_name), 1, 32) AS field_key, sha256(p_name || ':' || p_brand) AS blob FROM part")
def fingerprint(spark, sf_dir):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", hashing.store_fingerprint(t, n).alias("store_fp"), hashing.pipeline_fingerprint(b, t, n).alias("pipeline_fp"), hashing.source_sha(n).alias("source_sha"), hashing.content_hash(n).alias("content"), hashing.field_key(n).alias("field_key"), hashing.blob_key(n, b).alias("blob"))


@query("defect_id", "SELECT c_custkey, 'KOD-' || CAST(1000 + CAST('0x' || substr(sha256(c_name || '|' || c_mktsegment), 1, 6) AS BIGINT) % 9000 AS VARCHAR) AS defect_id FROM customer")
def defect_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.defect_id(F.col("c_name"), F.col("c_mktsegment")).alias("defect_id"))


@query("op_labels", "SELECT event_id, CASE event_type WHEN 'view' THEN 'Trim' WHEN 'click' THEN 'Keep digits' WHEN 'purchase' THEN 'Take first' ELSE event_type END AS label FROM events")
def op_labels(spark, sf_dir):
    op = F.when(F.col("event_type") == "view", "TRIM").when(F.col("event_type") == "click", "keepDigits").when(F.col("event_type") == "purchase", "takeFirst").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", st.op_label(op).alias("label"))


@query("accept_model", "SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 3 > 0 THEN event_id % 3 ELSE 1 END AS n_steps, CASE WHEN event_type = 'view' AND event_id % 3 > 0 THEN 'model' ELSE 'own' END AS origin FROM events")
def accept_model(spark, sf_dir):
    model = F.array_repeat(F.lit("model"), (F.col("event_id") % 3).cast("int"))
    got = st.accepted(F.when(F.col("event_type") != "error", F.col("event_type") == "view"), model, F.array(F.lit("own")))
    return table(spark, sf_dir, "events").select("event_id", F.size(got).cast("long").alias("n_steps"), F.get(got, F.lit(0)).alias("origin"))
