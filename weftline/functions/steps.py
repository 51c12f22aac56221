"""Canonical form of pipeline steps, as Column expressions over (kind, source_field, condition, op, value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.names import leaf, norm

#: The kinds of steps.
KINDS = ["READ", "FILTER", "SELECT", "TRANSFORM", "BUILD", "CONSTANT", "WRITE", "RAW"]
#: Spellings, normalised, of the operation that keeps digits and hyphens.
KEEP_DIGITS = ["keepdigits", "keepdigitsandhyphen", "keepdigitsandhyphens", "keepdigitshyphen"]
#: Labels of operations in views.
OP_LABELS = {
    "multiply": "Multiply",
    "add": "Add",
    "subtract": "Subtract",
    "divide": "Divide",
    "trim": "Trim",
    "split": "Split",
    "takefirst": "Take first",
    "takelast": "Take last",
    "takeindex": "Take index",
    "uppercase": "Uppercase",
    "lowercase": "Lowercase",
    "join": "Join",
    "lettersonly": "Letters only",
    "keepdigits": "Keep digits",
    "keepdigitsandhyphen": "Keep digits",
}


def kind(raw: Column) -> Column:
    """The canonical kind; anything unknown is RAW."""
    up = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(up.isin(KINDS), up).otherwise("RAW")


def original_kind(raw: Column) -> Column:
    """The kind as given, where it is not a known one."""
    return F.when(~F.upper(F.trim(F.coalesce(raw, F.lit("")))).isin(KINDS), raw)


def op(raw: Column) -> Column:
    """The operation, with the spellings of keep-digits folded."""
    return F.when(norm(raw).isin(KEEP_DIGITS), "keepDigits").otherwise(raw)


def op_label(raw: Column) -> Column:
    """What a view calls the operation; unknown ones by their own name."""
    table = F.create_map(*[F.lit(x) for pair in OP_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(raw)), raw)


def canonical(kind_col: Column, source: Column, condition: Column, op_col: Column, value: Column) -> Column:
    """A step with only the columns that its kind keeps: filters the condition, selects nothing, others the source field."""
    k = kind(kind_col)
    reads = k.isin("READ", "WRITE", "BUILD", "TRANSFORM")
    return F.struct(
        k.alias("kind"),
        F.when(reads, source).alias("source_field"),
        F.when(k == "FILTER", condition).alias("condition"),
        F.when(k == "TRANSFORM", op(op_col)).alias("op"),
        F.when(k.isin("TRANSFORM", "CONSTANT"), value).alias("value"),
        original_kind(kind_col).alias("original_kind"),
    )


def signature(kind_col: Column, source: Column, condition: Column, op_col: Column, value: Column) -> Column:
    """Kind, source, condition, operation and value as one string; missing ones are left out."""
    return F.concat_ws("|", F.upper(F.coalesce(kind_col, F.lit("?"))), source, condition, op_col, value)


def kinds_of(pipeline: Column) -> Column:
    return F.transform(pipeline, lambda s: F.upper(F.coalesce(s["kind"], F.lit("?"))))


def diverge(a: Column, b: Column) -> Column:
    """Whether two pipelines differ in any step signature or in their length."""
    return ~a.eqNullSafe(b)


def view_param(raw: Column) -> Column:
    """A number where the text is one; blank text stays text, null stays null. As (text, number)."""
    number = F.when(F.trim(F.regexp_replace(raw, r"[\x00-\x20]", " ")) != "", raw.try_cast("double"))
    return F.struct(F.when(number.isNull(), raw).alias("text"), number.alias("number"))


def unquoted(literal: Column) -> Column:
    """A quoted literal without its quotes; other text trimmed."""
    t = F.trim(literal)
    inner = F.regexp_extract(t, "^([\"'])(.*)\\1$", 2)
    return F.when(t.rlike("^([\"']).*\\1$"), inner).otherwise(t)


def write_target(field: Column, target_type: Column, schema_path: Column) -> Column:
    """Where a write goes in a view: the schema path of its leaf, else the dotted field, else below the type's name."""
    return F.coalesce(schema_path, F.when(F.instr(field, ".") > 0, field), F.concat(target_type, F.lit("."), field))


def same_leaf(path: Column, field: Column) -> Column:
    return norm(leaf(path)) == norm(leaf(field))


def without_code(meta: Column) -> Column:
    return F.map_filter(meta, lambda k, _: k != "code")


def accepted(recognised: Column, model: Column, own: Column) -> Column:
    """The model's pipeline if it is recognised and not empty, else the deterministic one."""
    return F.when(F.coalesce(recognised, F.lit(False)) & (F.size(model) > 0), model).otherwise(own)


def result_source(labelled: Column, cached: Column) -> Column:
    return F.when((labelled > 0) & (cached > 0), "mixed").when(cached > 0, "cache").otherwise("model")


def provenance(cached: Column, tool_loop: Column, escalated: Column) -> Column:
    return F.when(cached, "cache").when(tool_loop, "tool-loop").when(escalated, "escalation").otherwise("slice")


def token_usage(response: Column) -> Column:
    """Prompt and completion tokens of a JSON response in either of two vendors' shapes; missing ones are 0."""

    def first(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(response, p).try_cast("long") for p in paths], F.lit(0).cast("long"))

    return F.struct(first("$.usage.input_tokens", "$.usage.prompt_tokens").alias("prompt"), first("$.usage.output_tokens", "$.usage.completion_tokens").alias("completion"))
