"""End-to-end compositions: from source files to label tasks, and from steps to a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import capital, leaf, simple_type_name
from weftline.functions.text import injection_diagnostics, injections
from weftline.operators import audit
from weftline.operators.closure import nested_leaves
from weftline.operators.keyed import attribute, builder_sites
from weftline.operators.labeling import fallback_checklist, nested_upsert
from weftline.operators.pipeline import carry_forward, collect_fields, expand_write, fold_branches, schema_paths_for, view_steps, with_writes
from weftline.operators.slicing import heading, slices_of
from weftline.sources.java import parse, rows_of, scan
from weftline.sources.tables import Workspace, by_shuffle

BY = audit.BY
#: Texts of diagnostics.
UNATTRIBUTED = 'multi-instance-unattributed type "%s" line %d field %s — applied to all %d parent candidates'
DERIVED = "checklist derived from write sites only — unmapped fields cannot be detected in this mode"


def belongs(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """Sites (mapper_id, path, target, line, in_method, receiver, via, ...) whose receiver the method around declares, constructs or builds as the target.

    The method is the one of that name that holds the line, or else the first of that name. Links of a builder's chain always belong.
    """
    m = methods.select("path", F.col("name").alias("in_method"), "start_line", "end_line", "body_text")
    holds = F.col("line").between(F.col("start_line"), F.col("end_line"))
    best = F.min_by("body_text", F.struct((~holds).alias("away"), "start_line")).alias("body")
    each = Workspace(sites.sparkSession).keep_large(sites.withColumn("_site", F.monotonically_increasing_id()))
    body = each.join(m, ["path", "in_method"]).groupBy("_site").agg(best)
    kind = F.concat(F.lit(r"(?:[\w.]+\.)?"), "target")
    name = F.regexp_replace("receiver", r"([^\w])", r"\\$1")
    declared = F.concat(F.lit(r"\b"), kind, F.lit(r"\b\s+"), name, F.lit(r"\b"))
    made = F.concat(F.lit(r"\b"), name, F.lit(r"\s*=\s*(?:new\s+"), kind, F.lit(r"\b|"), kind, F.lit(r"\s*\.\s*builder\s*\()"))
    chain = (F.col("via") == "builder") | F.col("receiver").rlike(r"\.builder\s*\(\s*\)$")
    out = each.join(body, "_site", "left")
    return out.where(chain | F.coalesce(F.regexp("body", declared) | F.regexp("body", made), F.lit(False))).drop("_site", "body")


#: Kinds of rows that attribution asks for.
FOR_NESTED = ["methods", "chains"]


def nested_sites(sources: DataFrame, nested: DataFrame, parsed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes to the types within each mapper's target, with their dotted paths and a ``place`` for their order, and diagnostics.

    sources: (mapper_id, path, text); nested: (mapper_id, path: where in the target, type_name, order). A type at one place gets its
    writes there. Of a type at several places a write goes where a variable of its lifetime segment, or its method's result, is
    handed to a setter, a with-call or a builder's link of that place; it taints all places that do, or all there are. ``parsed`` is what
    ``parse`` found of ``FOR_NESTED`` in the sources, if they were parsed already.
    """
    work = Workspace(sources.sparkSession)
    code = sources.select("path", "text", "mapper_id")
    parsed = work.keep_large(parse(code, FOR_NESTED)) if parsed is None else parsed
    found = lambda kind: rows_of(parsed, kind).drop("target")
    nested = by_shuffle(nested.select("mapper_id", F.col("path").alias("prefix"), "type_name", F.col("order").alias("place")))
    each = sources.join(nested.select("mapper_id", F.col("type_name").alias("target")).distinct(), "mapper_id")
    sites = work.keep_large(belongs(scan(each, "write_sites"), found("methods").drop("mapper_id").distinct()).withColumn("site", F.monotonically_increasing_id()))
    count = nested.groupBy("mapper_id", F.col("type_name").alias("target")).agg(F.count("*").alias("places"))
    counted = sites.join(count, ["mapper_id", "target"])
    places = nested.withColumnRenamed("type_name", "target")
    one = counted.where("places = 1").join(places, ["mapper_id", "target"])
    several = work.keep_large(counted.where("places > 1"))

    # where a place takes something in: set, with or the bare name, of a variable or of a helper's result
    short = leaf(F.col("prefix"))
    routes = places.withColumn("method", F.explode(F.array(F.concat(F.lit("set"), capital(short)), F.concat(F.lit("with"), capital(short)), short)))
    taken = scan(code, "injections").join(routes, ["mapper_id", "method"]).select("mapper_id", "target", "prefix", "place", "name", "is_call", F.col("line").alias("at"))
    taken = work.keep_large(taken)
    assigned = work.keep_large(scan(code, "assignments").select("mapper_id", "name", F.col("line").alias("set_at")))

    def lifetime(rows: DataFrame, line: str, ids: list[str]) -> DataFrame:
        """Rows with the segment of their variable's lifetime: how often it was assigned up to the line."""
        met = rows.join(assigned, ["mapper_id", "name"], "left")
        return met.groupBy(*ids).agg(F.count_if(F.col("set_at") <= F.col(line)).alias("segment"))

    by_var = lifetime(taken.where("not is_call"), "at", ["mapper_id", "target", "prefix", "place", "name", "at"])
    chains = found("chains").withColumnRenamed("type", "target")
    bound = builder_sites(several.where(F.col("receiver") == F.concat("target", F.lit(".builder()"))), chains, ["mapper_id", "target"])
    vars_ = several.select("mapper_id", "target", "site", "line", F.col("receiver").alias("name")).unionByName(bound.select("mapper_id", "target", "site", "line", F.col("var").alias("name")))
    alive = lifetime(vars_, "line", ["mapper_id", "target", "site", "name", "line"])
    met = alive.join(by_var, ["mapper_id", "target", "name", "segment"]).select("mapper_id", "target", "site", "prefix")
    helped = several.join(taken.where("is_call").select("mapper_id", "target", "prefix", F.col("name").alias("in_method")), ["mapper_id", "target", "in_method"]).select("mapper_id", "target", "site", "prefix")
    injected = met.unionByName(helped).withColumn("segment", F.col("site"))
    routed = attribute(several.withColumn("segment", F.col("site")), injected, ["mapper_id", "target"], "prefix", places)
    told = routed.where("not attributed").select("mapper_id", "site", F.format_string(UNATTRIBUTED, "target", "line", "target_field", "places").alias("text")).distinct().drop("site")
    routed = routed.drop("segment", "attributed").join(places.select("mapper_id", "target", "prefix", "place"), ["mapper_id", "target", "prefix"])
    out = one.select(*routed.columns).unionByName(routed)
    return out.withColumn("target_field", F.concat_ws(".", "prefix", "target_field")).drop("prefix", "places", "site"), told


def build_tasks(mappers: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks (mapper_id, field, type, n_writes, state, slice_text) of every mapper, and diagnostics (mapper_id, text).

    mappers: (mapper_id, source_file, target_type, and class_name, if bare calls are to be looked up from that class); files: (path, text) of the whole tree. Fields are those that the mapper's own
    file declares for the target; else the leaves of its type in the tree, where writes to the types within are scanned too and
    attributed; else the writes themselves. States follow the audit, slices are joined by the whole key or else by the leaf.
    """
    work = Workspace(files.sparkSession)
    sources = work.keep_large(by_shuffle(mappers).select("mapper_id", F.col("source_file").alias("path"), simple_type_name(F.col("target_type")).alias("target"), *[c for c in ("class_name",) if c in mappers.columns]).join(files.select("path", "text"), "path"))
    tree_parsed = work.keep_large(parse(files.select("path", "text"), ["class_fields", "methods", "classes"]))
    parsed = work.keep_large(parse(sources, ["guarded_sites", "target_fields", "calls", *FOR_NESTED]))
    found = lambda kind: rows_of(parsed, kind).drop("target")
    classes = work.keep_large(rows_of(tree_parsed, "class_fields"))
    # of classes with one name that in a file of that name, else the first path
    home = classes.groupBy("class_name").agg(F.min_by("path", F.struct(~F.endswith("path", F.concat(F.lit("/"), "class_name", F.lit(".java"))), "path")).alias("path"))
    tree = work.keep(classes.join(home, ["class_name", "path"]))
    declared = work.keep_large(found("target_fields").select("mapper_id", F.col("name").alias("field"), "type"))
    away = sources.join(declared.select("mapper_id").distinct(), "mapper_id", "left_anti").select("mapper_id", F.col("target").alias("class_name"))
    leaves, reasons, nested = nested_leaves(tree, away)
    extra, unsure = nested_sites(sources.select("mapper_id", "path", "text"), nested, parsed)
    extra = work.keep(extra.withColumn("helpers", F.array().cast("array<string>")).withColumn("slice_text", F.concat_ws("\n", heading(), "statement")))
    # several mappers may have one file; two equal writes on a line stay two
    sites = rows_of(parsed, "guarded_sites", True).drop("mapper_id").distinct().drop("nth")
    if "class_name" in mappers.columns:  # bare calls are looked up from the mapper's class
        sites = sites.join(sources.select("path", "target", "class_name").distinct(), ["path", "target"])
    cut = slices_of(sites, tree_parsed)
    keep = ["path", "via", "in_method", "receiver", "helpers", "slice_text"]
    own = sources.select("mapper_id", "path", "target").join(cut, ["path", "target"]).select("mapper_id", "line", "target_field", *keep)
    sites = work.keep_large(nested_upsert(own, extra.select("mapper_id", "line", "target_field", "place", *keep), BY, "place"))
    fields = declared.unionByName(leaves.select("mapper_id", F.col("path").alias("field"), "type"))
    bare = sites.join(fields.select("mapper_id").distinct(), "mapper_id", "left_anti")
    derived = fallback_checklist(bare, BY).select("mapper_id", "field", F.lit(None).cast("string").alias("type"))
    fields = work.keep_large(fields.unionByName(derived))
    check = work.keep_large(audit.checklist(fields, sites, by_shuffle(audit.opaque(found("calls"), sites))))
    shown = audit.writes(fields, sites).groupBy("mapper_id", "field").agg(F.array_sort(F.collect_list(F.struct("line", "slice_text"))).alias("s"))
    shown = shown.select("mapper_id", "field", F.array_join(F.transform("s", lambda x: x["slice_text"]), "\n\n").alias("slice_text"))
    tasks = work.keep_large(check.join(shown, ["mapper_id", "field"], "left"))
    own_code = sources.select("path", "text", "mapper_id")
    told = audit.miss_diagnostics(audit.missed_writes(scan(own_code, "loose_writes"), sites), audit.unmapped_mentions(tasks.where("state = 'unmapped'").select("mapper_id", "field"), scan(own_code, "lines")))
    told = told.unionByName(unsure).unionByName(reasons.select("mapper_id", F.concat_ws(": ", "path", "reason").alias("text")))
    told = told.unionByName(derived.select("mapper_id", F.lit(DERIVED).alias("text")).distinct())
    risky = injections(tasks.where("slice_text is not null").select(F.struct("mapper_id", "field").alias("key"), "slice_text"), "key", "slice_text")
    risky = risky.select(F.col("key.mapper_id").alias("mapper_id"), F.col("key.field").alias("field"), "why", "excerpt")
    return tasks, told.unionByName(injection_diagnostics(risky, "field", ["mapper_id"]))


def view(steps: DataFrame, target_type: Column, source_type: Column | None = None, paths: DataFrame | None = None) -> DataFrame:
    """A pipeline's view rows (pipeline, pos, part, view_kind, label, shown_value, target, parent): sources filled, writes ended and
    taken apart, targets looked up among schema paths, branches folded.

    A WRITE whose summary is code becomes the steps that the code stands for, as parts of its place. ``paths`` (path, pos) are the
    schema's; without them targets are named by the field or below the type.
    """
    full = with_writes(carry_forward(steps))
    for c in ("op", "condition", "value", "schema_path", "summary"):
        if c not in full.columns:
            full = full.withColumn(c, F.lit(None).cast("string"))
    if paths is not None:
        full = schema_paths_for(full.drop("schema_path").withColumn("field", F.col("target_field")), paths).drop("field")
    shown = fold_branches(view_steps(full, target_type))
    parts = F.array(F.struct(F.col("view_kind").alias("kind"), F.col("label").alias("op"), F.lit(None).cast("string").alias("field")))
    if source_type is not None:
        code = (F.col("view_kind") == "write") & F.col("summary").isNotNull()
        parts = F.when(code, expand_write(F.col("summary"), source_type)).otherwise(parts)
    out = shown.select("pipeline", "pos", F.posexplode(parts).alias("part", "p"), "shown_value", "target", "parent")
    write = F.col("p.kind").isin("write", "constant", "build")
    return out.select("pipeline", "pos", "part", F.col("p.kind").alias("view_kind"), F.col("p.op").alias("label"), "shown_value", F.when(write, F.col("target")).alias("target"), "parent")


def view_fields(steps: DataFrame, target_type: Column, source_type: Column | None = None, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A pipeline's view rows, and the distinct source and target names of each pipeline."""
    return view(steps, target_type, source_type, paths), collect_fields(steps, "pipeline")
