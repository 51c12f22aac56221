"""Pipelines as rows (pipeline, pos, kind, ...): filling, folding, grouping and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import leaf, norm
from weftline.functions.steps import op_label, write_target


def ordered(by: str, order: str = "pos") -> Window:
    return Window.partitionBy(by).orderBy(order)


def carry_forward(steps: DataFrame, by: str = "pipeline", order: str = "pos") -> DataFrame:
    """Give the source of the last READ to a TRANSFORM or FILTER that has none; keep a reason on the first step only."""
    before = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    read = F.last(F.when(F.col("kind") == "READ", F.col("source_field")), True).over(before)
    out = steps.withColumn("source_field", F.when(F.col("kind").isin("TRANSFORM", "FILTER"), F.coalesce("source_field", read)).otherwise(F.col("source_field")))
    if "label_reason" in steps.columns:
        out = out.withColumn("label_reason", F.when(F.row_number().over(ordered(by, order)) == 1, F.col("label_reason")))
    return out


def with_writes(steps: DataFrame, by: str = "pipeline", order: str = "pos") -> DataFrame:
    """Add a WRITE step after pipelines that end in another kind."""
    last = steps.groupBy(by).agg(F.max_by(F.struct(order, "kind"), order).alias("l")).where(F.col("l.kind") != "WRITE")
    return steps.unionByName(last.select(by, (F.col(f"l.{order}") + 1).alias(order), F.lit("WRITE").alias("kind")), allowMissingColumns=True)


def fold_branches(steps: DataFrame, by: str = "pipeline", order: str = "pos") -> DataFrame:
    """parent: the FILTER that a step belongs to, or the step itself.

    A filter takes the run of TRANSFORMs after it or, where there is none, one CONSTANT.
    """
    w = ordered(by, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("_filter", F.last(F.when(F.col("kind") == "FILTER", F.col(order)), True).over(upto))
    # within a filter's island: whether all steps after it so far are transforms
    island = Window.partitionBy(by, "_filter").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    other = F.sum(F.when(F.col("kind").isin("FILTER", "TRANSFORM"), 0).otherwise(1)).over(island)
    n = F.row_number().over(Window.partitionBy(by, "_filter").orderBy(order))
    inside = F.col("_filter").isNotNull() & ((F.col("kind") == "TRANSFORM") & (other == 0) | (F.col("kind") == "CONSTANT") & (n == 2))
    return out.withColumn("parent", F.when(inside, F.col("_filter")).otherwise(F.col(order))).drop("_filter")


def group_by_target(ops: DataFrame, by: str = "pipeline", order: str = "pos", target: str = "target_field") -> DataFrame:
    """Operations of each target in order. One without a target goes to the next target; what follows the last target is lost, as are returns."""
    ahead = ordered(by, order).rowsBetween(0, Window.unboundedFollowing)
    some = ops.where(F.coalesce(F.col(target), F.lit("")) != "<return>")
    out = some.withColumn("_t", F.first(target, True).over(ahead)).where("_t is not null")
    return out.groupBy(by, F.col("_t").alias(target)).agg(F.array_sort(F.collect_list(F.struct(order, "kind"))).alias("ops"))


def schema_paths_for(fields: DataFrame, paths: DataFrame) -> DataFrame:
    """Fields with the first schema path (path, pos) of an equal normalised leaf."""
    first = paths.groupBy(norm(leaf(F.col("path"))).alias("_k")).agg(F.min_by("path", "pos").alias("schema_path"))
    return fields.withColumn("_k", norm(leaf(F.col("field")))).join(first, "_k", "left").drop("_k")


def view_steps(steps: DataFrame, target_type: Column) -> DataFrame:
    """A view's rows: kind, label, value and target of each step; returns are left out. Needs schema_path."""
    k = F.lower(F.coalesce("kind", F.lit("raw")))
    shown = steps.where(~((k == "write") & (F.coalesce("target_field", F.lit("")) == "<return>")))
    label = F.when(k == "transform", op_label(F.col("op"))).when(k == "filter", F.lit("matches"))
    value = F.when(k == "filter", F.col("condition")).when(k.isin("transform", "constant"), F.col("value"))
    where = F.when(k.isin("write", "constant", "build"), write_target(F.col("target_field"), target_type, F.col("schema_path")))
    return shown.withColumn("view_kind", k).withColumn("label", label).withColumn("shown_value", value).withColumn("target", where)


def expand_write(text: Column, source_type: Column) -> Column:
    """Steps that a write's code stands for: two reads and a join for first and last name, an upper-casing, else the write."""
    names = F.contains(text, F.lit("getFirstName()")) & F.contains(text, F.lit("getLastName()")) & F.contains(text, F.lit("+"))

    def step(kind: str, op: str | None = None, field: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(op).cast("string").alias("op"), (field if field is not None else F.lit(None).cast("string")).alias("field"))

    first, last = F.concat(source_type, F.lit(".firstName")), F.concat(source_type, F.lit(".lastName"))
    both = F.array(step("read", field=first), step("read", field=last), step("transform", "Join text", first), step("write"))
    return F.when(names, both).when(F.contains(text, F.lit(".toUpperCase()")), F.array(step("transform", "Uppercase"), step("write"))).otherwise(F.array(step("write")))


def collect_fields(steps: DataFrame, by: str) -> DataFrame:
    """Distinct source and target names of each pipeline, sorted."""
    pick = lambda c: F.array_sort(F.collect_set(c))
    return steps.groupBy(by).agg(pick("source_field").alias("sources"), pick("target_field").alias("targets"))


def merge_field_lists(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))


def flatten_mapping(mappings: DataFrame, by: str = "pipeline") -> DataFrame:
    """Steps of grouped mappings (by, target_field, ops: array of steps) as rows in order, each with its target; summaries trimmed, blank ones left out."""
    rows = mappings.select(by, "target_field", F.posexplode("ops").alias("pos", "step"))
    out = rows.select(by, F.coalesce("step.target_field" if "target_field" in mappings.schema["ops"].dataType.elementType.names else "target_field", "target_field").alias("target_field"), "pos", *[F.col(f"step.{c}").alias(c) for c in mappings.schema["ops"].dataType.elementType.names if c not in ("target_field", "pos")])
    return out.withColumn("summary", F.nullif(F.trim("summary"), F.lit(""))) if "summary" in out.columns else out


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """Rows with their place, from 1, in a total order: ranges are sorted and numbered where they are, behind the counts of the ranges before."""
    from weftline.sources.tables import Workspace

    ranged = rows.withColumn("_o", order).repartitionByRange("_o").sortWithinPartitions("_o").drop("_o").withColumn("_id", F.monotonically_increasing_id())
    kept = Workspace(rows.sparkSession).keep(ranged)
    part = F.shiftright("_id", 33)
    sums = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    out = kept.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*rows.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
