"""Completeness audit: declared fields against write sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.names import capital, leaf, norm
from weftline.functions.steps import kinds_of
from weftline.functions.text import words_in
from weftline.sources.tables import Workspace

#: What a named operation looks like in code.
OP_EVIDENCE = {
    "multiply": ["*", "multiply"],
    "keepdigits": ["isdigit", "keepdigits", "digit"],
    "lettersonly": ["isletter", "letter"],
    "uppercase": ["toupper", "uppercase"],
    "lowercase": ["tolower", "lowercase"],
    "trim": ["trim"],
    "split": ["split"],
    "takefirst": ["[0]", "takefirst", "parts[0]"],
    "takelast": ["takelast", "parts["],
}
#: Prefixes of diagnostics that are misses.
MISS_KINDS = ["possible-missed-write", "unmapped-but-mentioned", "multi-instance-unattributed", "prompt-injection-risk"]


#: What tells one mapper's rows from another's; calls, lines and writes have the path of their file besides.
BY = ["mapper_id"]


def opaque(calls: DataFrame, sites: DataFrame, by: list[str] = BY, file: str = "path") -> DataFrame:
    """Calls by a capital name that mention a receiver of their mapper's writes, on lines of their file without a known write.

    calls: (by, file, line, callee, args). Arguments are taken apart into words that are joined with the receivers, so no list
    of receivers is held anywhere. A call within whose arguments another one stands counts by the inner one only.
    """
    known = sites.select(*by, F.col("receiver").alias("_word")).where(~F.contains("_word", F.lit("("))).distinct()
    away = calls.where(F.col("callee").rlike("^[A-Z]") & ~F.col("args").rlike("[()]")).join(sites.select(*by, file, "line").distinct(), [*by, file, "line"], "left_anti")
    words = away.withColumn("_word", F.explode(F.array_distinct(F.regexp_extract_all("args", F.lit(r"\w+"), F.lit(0)))))
    return words.join(known, [*by, "_word"], "left_semi").drop("_word").distinct()


def _keyed(fields: DataFrame) -> DataFrame:
    return fields.withColumn("_full", norm(F.col("field"))).withColumn("_leaf", norm(leaf(F.col("field"), strip_array=False)))


def checklist(fields: DataFrame, sites: DataFrame, escapes: DataFrame | None = None, by: list[str] = BY) -> DataFrame:
    """Every declared field (by, field) with n_writes and its state: mapped, or without a write unmapped, or unresolved when an
    opaque call of its mapper could write it.

    Writes count under a field's whole key or else, where they are named so, under its leaf. They are counted by key before the
    join, so a hot key is one number; ``writes`` has the rows.
    """
    n = sites.groupBy(*by, norm(F.col("target_field")).alias("_k")).agg(F.count("*").alias("_n"))
    out = _keyed(fields)
    for key in ("_full", "_leaf"):
        out = out.join(n.withColumnRenamed("_k", key).withColumnRenamed("_n", f"_n{key}"), [*by, key], "left")
    tainted = F.lit(False)
    if escapes is not None:
        out = out.join(escapes.select(*by).distinct().withColumn("_tainted", F.lit(True)), by, "left")
        tainted = F.coalesce("_tainted", F.lit(False))
    out = out.withColumn("n_writes", F.coalesce("_n_full", "_n_leaf", F.lit(0)).cast("long"))
    state = F.when(F.col("n_writes") > 0, "mapped").when(tainted, "unresolved").otherwise("unmapped")
    return out.withColumn("state", state).select(*fields.columns, "n_writes", "state")


def writes(fields: DataFrame, sites: DataFrame, by: list[str] = BY) -> DataFrame:
    """The writes of every declared field as rows (by, field and the site's other columns), by its whole key or else by its leaf."""
    keyed = _keyed(fields.select(*by, "field"))
    rows = sites.withColumn("_k", norm(F.col("target_field")))
    known = rows.select(*by, "_k").distinct()
    full = keyed.join(known.withColumnRenamed("_k", "_full"), [*by, "_full"], "left_semi").withColumn("_k", F.col("_full"))
    short = keyed.join(known.withColumnRenamed("_k", "_full"), [*by, "_full"], "left_anti").withColumn("_k", F.col("_leaf"))
    return full.unionByName(short).drop("_full", "_leaf").join(rows, [*by, "_k"]).drop("_k")


def orphans(fields: DataFrame, sites: DataFrame, by: list[str] = BY) -> DataFrame:
    """Writes whose whole key and leaf are both undeclared in their mapper."""
    keyed = _keyed(fields)
    rest = sites.withColumn("_k", norm(F.col("target_field"))).join(keyed.select(*by, F.col("_full").alias("_k")).distinct(), [*by, "_k"], "left_anti")
    rest = rest.withColumn("_k", norm(leaf(F.col("target_field"), strip_array=False)))
    return rest.join(keyed.select(*by, F.col("_leaf").alias("_k")).distinct(), [*by, "_k"], "left_anti").drop("_k")


def gate(check: DataFrame, orphan: DataFrame | None = None, by: list[str] = BY) -> DataFrame:
    """By mapper (or, with no ``by``, in all): counts by state, the mapped share in percent and whether the gate passes: nothing
    unresolved, no orphan write."""
    n = check.groupBy(*by).agg(F.count("*").alias("declared"), *[F.count_if(F.col("state") == s).alias(s) for s in ("mapped", "unmapped", "unresolved")])
    pct = F.coalesce(F.round(F.try_divide(100.0 * F.col("mapped"), F.col("declared"))), F.lit(0.0)).cast("long")
    lost = F.lit(0)
    if orphan is not None:
        counts = orphan.groupBy(*by).agg(F.count("*").alias("_orphans"))
        n = n.join(counts, by, "left") if by else n.join(F.broadcast(counts), how="cross")  # without by both sides are one row
        lost = F.coalesce("_orphans", F.lit(0))
    return n.withColumn("mapped_pct", pct).withColumn("gate_passed", (F.col("unresolved") == 0) & (lost == 0)).drop("_orphans")


def missed_writes(loose: DataFrame, sites: DataFrame, by: list[str] = BY, file: str = "path") -> DataFrame:
    """Loose candidates (by, file, line, evidence, hint) on no known line of their file that name no known field of their mapper."""
    rest = loose.join(sites.select(*by, file, "line").distinct(), [*by, file, "line"], "left_anti")
    named = norm(F.nullif(F.regexp_extract("evidence", r"\.(?:set|with)([A-Z]\w*)", 1), F.lit("")))
    known = sites.select(*by, norm(F.col("target_field")).alias("_k")).distinct()
    return rest.withColumn("_k", named).join(known, [*by, "_k"], "left_anti").drop("_k")


#: Words that may be sent with a plan as a list; counted before.
FEW_WORDS = 2000


def unmapped_mentions(fields: DataFrame, lines: DataFrame, by: list[str] = BY, file: str = "path") -> DataFrame:
    """Unmapped fields (by, field) that their mapper's text still names: by, field, path, line, evidence by the first of set,
    get, is, with and bare name.

    The words of the lines (by, file, line, text, and bare: the text to search, if it is another) are joined by equality with the
    forms of the fields. Where the forms are counted to be few, all other words go before lines are taken apart. A word's first place
    is found where the lines are, so what is shuffled is the words that a task has, not those of every line; evidence is looked up at last.
    """
    short = leaf(F.col("field"), strip_array=False)
    forms = F.array(*[F.struct(F.lit(i).alias("rank"), (F.concat(F.lit(p), capital(short)) if p else short).alias("word")) for i, p in enumerate(["set", "get", "is", "with", ""])])
    wanted = fields.select(*by, "field", F.explode(forms).alias("f")).select(*by, "field", "f.rank", "f.word").where("word <> ''")
    found = F.array_distinct(F.regexp_extract_all(F.col("bare" if "bare" in lines.columns else "text"), F.lit(r"\w+"), F.lit(0)))
    few = [r[0] for r in wanted.select("word").distinct().limit(FEW_WORDS + 1).collect()]
    if len(few) <= FEW_WORDS:
        found = F.array_intersect(found, F.array(*map(F.lit, few)).cast("array<string>"))
    first = _first_places(lines, found, by, file)
    hit = wanted.join(first, [*by, "word"]).groupBy(*by, "field").agg(F.min(F.struct("rank", file, "line", "word")).alias("h"))
    hit = Workspace(fields.sparkSession).keep(hit.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("field").alias("_field"), F.col(f"h.{file}").alias("_file"), F.col("h.line").alias("_line"), "h.word"))
    same = F.col("_file").eqNullSafe(F.col(file)) & (F.col("_line") == F.col("line"))
    for c in by:
        same = same & (F.col(f"_{c}") == F.col(c))
    met = lines.join(hit, same).where(F.array_contains(found, F.col("word")))
    evidence = F.min(F.substring(F.trim("text"), 1, 120)).alias("evidence")
    return met.groupBy(*by, F.col("_field").alias("field"), file, "line").agg(evidence)


def _first_places(lines: DataFrame, words: Column, by: list[str], file: str) -> DataFrame:
    """by, word, file and line of the least (file, line) that has each word of a mapper; a null file comes first.

    Both ways aggregate in hash tables, so no task sorts its words: a file that is a whole number makes one number with its line, of others
    the first line in each file is found before.
    """
    kind = lines.schema[file].dataType
    if not isinstance(kind, T.IntegralType):
        each = lines.select(*by, file, "line", F.explode(words).alias("word")).groupBy(*by, "word", file).agg(F.min("line").alias("line"))
        return each.groupBy(*by, "word").agg(F.min(F.struct(file, "line")).alias("_p")).select(*by, "word", f"_p.{file}", "_p.line")
    room, none = F.lit(2**32).cast("decimal(10,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)")
    place = (F.coalesce(F.col(file).cast("decimal(20,0)"), none) * room + F.col("line").cast("decimal(10,0)")).cast("decimal(30,0)")
    least = lines.select(*by, place.alias("_p"), F.explode(words).alias("word")).groupBy(*by, "word").agg(F.min("_p").alias("_p"))
    line = F.pmod("_p", room)
    number = ((F.col("_p") - line) / room).cast("decimal(20,0)")
    return least.select(*by, "word", F.when(number > none, number).cast(kind).alias(file), line.cast(lines.schema["line"].dataType).alias("line"))


def miss_diagnostics(missed: DataFrame, mentions: DataFrame, by: list[str] = BY) -> DataFrame:
    a = missed.select(*by, F.format_string("possible-missed-write line %d (%s): %s", "line", "hint", "evidence").alias("text"))
    return a.unionByName(mentions.select(*by, F.format_string("unmapped-but-mentioned %s line %d: %s", "field", "line", "evidence").alias("text")))


def classify_misses(diagnostics: DataFrame, fields: DataFrame) -> DataFrame:
    """kind, field, line and text of every miss in diagnostics (text) and in checklist rows (field, state, note)."""
    t = F.col("text")
    kind = F.coalesce(*[F.when(F.startswith(t, F.lit(p)), p) for p in MISS_KINDS])
    field = F.when(kind == MISS_KINDS[1], F.regexp_extract(t, r"^unmapped-but-mentioned\s+(\S+)", 1)).when(kind == MISS_KINDS[3], F.regexp_extract(t, r"^prompt-injection-risk\s+(\S+?):", 1)).when(kind == MISS_KINDS[2], F.regexp_extract(t, r"\bfield\s+(\S+)", 1))
    line = F.regexp_extract(t, r"(?i)\bline\s+(\d+)\b", 1).try_cast("int")
    told = diagnostics.select(kind.alias("kind"), F.nullif(field, F.lit("")).alias("field"), line.alias("line"), "text").where("kind is not null")
    note = F.col("note")
    crossed = F.when(F.startswith(note, F.lit("cross-check:")), F.struct(F.lit("cross-check").alias("kind"), F.concat("field", F.lit(": "), note).alias("text")))
    state = F.when(F.col("state").isin("unmapped", "unresolved"), F.struct(F.col("state").alias("kind"), F.concat("field", F.lit(": "), F.coalesce(note, F.when(F.col("state") == "unmapped", "unmapped (no write site)").otherwise("unresolved"))).alias("text")))
    rows = fields.select("field", F.explode(F.array_compact(F.array(crossed, state))).alias("m"))
    return told.unionByName(rows.select("m.kind", "field", F.lit(None).cast("int").alias("line"), "m.text"))


def ungrounded(steps: DataFrame, slices: DataFrame, schema_paths: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Steps (by, field, pos, kind, source_field, op, value) that the slice of their field (by, field, text) gives no evidence for.

    A read of a leaf of the schema's paths (by, path) is grounded.
    """
    by = by or []
    s = steps.join(slices, [*by, "field"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    if schema_paths is not None:
        known = schema_paths.select(*by, F.lower(F.substring_index("path", ".", -1)).alias("_leaf")).distinct().withColumn("in_schema", F.lit(True))
        s = s.withColumn("_leaf", F.lower(F.substring_index("source_field", ".", -1))).join(known, [*by, "_leaf"], "left").drop("_leaf")
    else:
        s = s.withColumn("in_schema", F.lit(False))
    evidence = F.create_map(*[x for k, v in OP_EVIDENCE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = F.coalesce(F.try_element_at(evidence, F.lower("op")), F.array("op"))
    read = (F.col("kind") == "READ") & (F.col("source_field").isNull() | ~F.coalesce("in_schema", F.lit(False)) & ~words_in(F.col("text"), F.col("source_field")))
    op = (F.col("kind") == "TRANSFORM") & F.col("op").isNotNull() & ~words_in(F.col("text"), F.col("op")) & ~F.exists(words, lambda w: words_in(F.col("text"), w))
    constant = (F.col("kind") == "CONSTANT") & (F.coalesce("value", F.lit("")) != "") & ~words_in(F.col("text"), F.col("value"))
    return s.withColumn("detail", F.when(read, "READ not grounded").when(op, "TRANSFORM not grounded").when(constant, "CONSTANT not grounded")).where("detail is not null").drop("text", "in_schema")


def scores(pipelines: DataFrame, declared: int | Column | DataFrame, bad: DataFrame, sliced: DataFrame, by: list[str] | None = None) -> DataFrame:
    """coverage, grounding, specificity and provenance of mapped fields (by, field, pipeline); an empty side counts as 1.

    With ``by`` there is a row for each mapper of ``declared`` (by, declared); without, declared is a number and there is one row.
    """
    by = by or []
    each = pipelines.select(*by, "field", F.size("pipeline").alias("steps"), F.size(F.filter(kinds_of(F.col("pipeline")), lambda k: k == "RAW")).alias("raw"))
    each = each.join(sliced.select(*by, "field").distinct().withColumn("sliced", F.lit(1)), [*by, "field"], "left")
    n = each.groupBy(*by).agg(F.count("*").alias("mapped"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("steps", "raw", "sliced")])
    lost = bad.groupBy(*by).agg(F.count("*").alias("bad"))
    if by:
        n = declared.select(*by, F.col("declared").alias("_d")).join(n, by, "left").join(lost, by, "left").na.fill(0, ["mapped", "steps", "raw", "sliced", "bad"])
        d = F.col("_d")
    else:
        n, d = n.join(F.broadcast(lost), how="cross"), F.lit(declared) if isinstance(declared, int) else declared
    share = lambda part, of: F.coalesce(F.round(1 - F.try_divide(F.col(part).cast("double"), F.col(of)), 4), F.lit(1.0))
    return n.select(*by, F.round(F.least(F.lit(1.0), F.col("mapped") / F.greatest(d, F.lit(1))), 4).alias("coverage"), share("bad", "steps").alias("grounding"), share("raw", "steps").alias("specificity"), F.coalesce(F.round(F.try_divide(F.col("sliced").cast("double"), F.col("mapped")), 4), F.lit(1.0)).alias("provenance"))


def provenance(mapped: DataFrame, sliced: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many mapped fields (by, field) there are, how many of them have a slice, and their share."""
    by = by or []
    each = mapped.join(sliced.select(*by, "field").distinct().withColumn("_sliced", F.lit(1)), [*by, "field"], "left")
    n = each.groupBy(*by).agg(F.count("*").alias("mapped"), F.count("_sliced").alias("with_slice"))
    return n.withColumn("provenance", F.coalesce(F.round(F.try_divide(F.col("with_slice").cast("double"), F.col("mapped")), 4), F.lit(1.0)))


def task_of(fields: DataFrame, tasks: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Fields (by, field, ...) with the value of the task they belong to; without one they are left out.

    It is the task (by, field, pos, value) of the same name in any case, of several the last; else the first of those whose name ends the field's after a
    dot, or end in a dot and the field's last part. Endings are looked up by equality, in tables with one row for each name, so
    neither many tasks nor many fields of one last part meet in pairs.
    """
    by = by or []
    low = F.lower("field")
    exact = tasks.groupBy(*by, low.alias("_name")).agg(F.min("pos").alias("_at"), F.max_by(value, "pos").alias("_value"))
    first = F.min(F.struct(F.col("_at").alias("at"), F.col("_value").alias("value")))
    dotted = exact.where(F.contains("_name", F.lit("."))).groupBy(*by, F.substring_index("_name", ".", -1).alias("_tail")).agg(first.alias("_inner"))
    own = fields.withColumn("_name", low).withColumn("_tail", F.substring_index("_name", ".", -1))
    parts = F.split("_name", r"\.")
    ends = own.select(*by, "_name").distinct().withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))))).where(F.size(parts) > 1)
    ends = ends.select(*by, F.col("_name").alias("_of"), F.array_join(F.slice(parts, F.size(parts) - F.col("_n") + 1, F.col("_n")), ".").alias("_name"))
    ended = ends.join(exact, [*by, "_name"]).groupBy(*by, F.col("_of").alias("_name")).agg(first.alias("_outer"))
    out = own.join(exact.drop("_at"), [*by, "_name"], "left").join(ended, [*by, "_name"], "left").join(dotted, [*by, "_tail"], "left")
    found = F.coalesce(F.when(F.col("_value").isNotNull(), F.col("_value")), F.least("_outer", "_inner")["value"])
    return out.withColumn(value, found).where(F.col(value).isNotNull()).drop("_name", "_tail", "_value", "_outer", "_inner")


def smells(closures: DataFrame, pipelines: DataFrame, depth: int = 4, few: int = 2, by: list[str] | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """Fields (by, field, pipeline) whose task's helpers (by, field, helper) are many though their pipeline has one or two steps.

    ``tasks`` (by, field, pos) are all tasks in order, by default those that have helpers, by name; ``task_of`` tells which one is a field's.
    """
    by = by or []
    deep = closures.groupBy(*by, "field").agg(F.countDistinct("helper").alias("closure_depth"))
    if tasks is None:
        all_ = deep.withColumn("pos", F.col("field"))
    else:
        all_ = tasks.join(deep, [*by, "field"], "left").withColumn("closure_depth", F.coalesce("closure_depth", F.lit(0)).cast("long"))
    short = pipelines.select(*by, "field", F.size("pipeline").alias("steps")).where(F.col("steps").between(1, few))
    return task_of(short, all_, "closure_depth", by).where(F.col("closure_depth") >= depth).select(*by, "field", "steps", "closure_depth")


def cross_check(claims: DataFrame, check: DataFrame, text: Column, by: list[str] | None = None) -> DataFrame:
    """Claims (by, field, evidence, and line if they name one) on unmapped fields with a verified citation, which turn the field unresolved; others with the reason they are dropped.

    Where claims have lines, a claim's has to be a whole number and is cited with the evidence.
    """
    from weftline.functions.text import verified_citation

    by = by or []
    state = check.groupBy(*by, F.lower("field").alias("_k")).agg(F.min_by("state", F.struct(F.col("state") != "unmapped", "field")).alias("state"))
    out = claims.withColumn("_k", F.lower("field")).join(state, [*by, "_k"], "left").drop("_k")
    said, whole = F.col("evidence"), F.lit(True)
    if "line" in claims.columns:
        named = F.regexp_extract(F.col("line").cast("string"), r"^(-?\d+)(?:\.0*)?$", 1)
        said, whole = F.concat(F.lit("line "), named, F.lit(": "), F.coalesce("evidence", F.lit(""))), F.coalesce(named != "", F.lit(False))
    reason = F.when(F.col("state").isNull(), "unknown field").when(F.col("state") != "unmapped", "not unmapped").when(~whole | ~verified_citation(said, text), "no citation")
    return out.withColumn("dropped", reason)


def smell_diagnostics(found: DataFrame, by: list[str] = BY) -> DataFrame:
    """Step smells (by, field, detail) as lines of text."""
    return found.select(*by, F.concat(F.lit("step-smell "), "field", F.lit(": "), "detail").alias("text"))
