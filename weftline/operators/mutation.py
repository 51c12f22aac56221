"""Mutation checks as one differential audit: every write site is changed in turn, and all changed sources are audited beside the originals.

A mutant is the source with one statement spliced at its place: left out, or with a constant or an operation in it changed. It counts as found if its
field is demoted, or if the field's steps, grounded before, aren't grounded any more; others survive. A mutant is a row, so a mapper with many writes is many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import audit
from weftline.sources.java import parse, rows_of
from weftline.sources.tables import Workspace

KEY = ["mapper_id", "mutant"]


def changed_statement(kind: str, statement: Column) -> Column:
    """The statement as a kind of mutant has it; equal to it where the kind doesn't apply."""
    flip = F.when(statement.rlike(r"\btrue\b"), F.regexp_replace(statement, r"\btrue\b", "false")).otherwise(F.regexp_replace(statement, r"\bfalse\b", "true"))
    return {
        "drop-write": F.regexp_replace(statement, r"[^\n]", " "),
        "flip-flag": flip,
        "change-number": F.regexp_replace(statement, r"(?<![\w.*/+\-] ?)\b\d+\b(?!\s*[*/])", "987654321"),
        "change-text": F.regexp_replace(statement, r'"[^"]+"', '"~"'),
        "drop-operation": F.regexp_replace(statement, r"\s*[*/]\s*\d+", ""),
    }[kind]


KINDS = ["drop-write", "flip-flag", "change-number", "change-text", "drop-operation"]


def mutants(sources: DataFrame, sites: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """mapper_id, mutant, kind, field, line, path, target and text: a source for each site (mapper_id, path, line, target_field, statement) and kind that changes its statement.

    The statement is looked for from its line on, so of two equal ones on two lines each has a mutant of its own, on one line they have one; one that isn't found as it stands has none.
    """
    met = sites.select("mapper_id", "path", "line", F.col("target_field").alias("field"), "statement").join(sources.select("mapper_id", "path", "target", "text"), ["mapper_id", "path"])
    before = F.array_join(F.slice(F.split("text", "\n", -1), F.lit(1), F.col("line") - 1), "\n")
    met = met.withColumn("begin", F.when(F.col("line") > 1, F.length(before) + 2).otherwise(1)).withColumn("at", F.expr("locate(statement, text, begin)")).where("at > 0")
    made = met.withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), changed_statement(k, F.col("statement")).alias("put")) for k in kinds]))).where("m.put <> statement")
    text = F.concat(F.expr("substring(text, 1, at - 1)"), F.col("m.put"), F.expr("substring(text, at + length(statement))"))
    made = made.dropDuplicates(["mapper_id", "path", "target", "at", "m"])
    return made.select("mapper_id", F.concat_ws(":", "line", "at", "m.kind").alias("mutant"), "m.kind", "field", "line", "path", "target", text.alias("text"))


def read(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fields, sites and calls of sources (key, path, target, text), by key."""
    work = Workspace(sources.sparkSession)
    parsed = work.keep(parse(sources.select(F.col("key").alias("mapper_id"), "path", "target", "text"), ["target_fields", "guarded_sites", "calls"]))
    return rows_of(parsed, "target_fields").select("mapper_id", F.col("name").alias("field")), rows_of(parsed, "guarded_sites"), rows_of(parsed, "calls")


def check(sources: DataFrame, steps: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """mapper_id, kind, field, line and outcome (demoted, ungrounded or survived) of every mutant of sources (mapper_id, path, target, text).

    ``steps`` (mapper_id, field, pos, kind, source_field, op, value) are the pipelines that the originals have.
    """
    work = Workspace(sources.sparkSession)
    plain = sources.withColumn("mutant", F.lit(""))
    _, sites, _ = read(plain.withColumn("key", F.col("mapper_id").cast("string")))
    own = sources.select("mapper_id", F.col("mapper_id").cast("string").alias("key"))
    made = work.keep(mutants(sources, sites.withColumnRenamed("mapper_id", "key").join(own, "key").drop("key"), kinds))
    every = plain.select(*KEY, "path", "target", "text").unionByName(made.select(*KEY, "path", "target", "text"))
    every = work.keep(every.withColumn("key", F.concat_ws("/", "mapper_id", "mutant")))
    fields, sites, calls = read(every)
    sites = work.keep(sites)
    states = audit.checklist(fields, sites, audit.opaque(calls, sites)).select(F.col("mapper_id").alias("key"), "field", "state")
    shown = F.concat_ws("\n", "control_flow", "statement")
    texts = sites.groupBy("mapper_id", F.col("target_field").alias("field")).agg(F.array_join(F.array_sort(F.collect_list(shown)), "\n").alias("text"))  # a field's own sites in one file
    keyed = every.select("key", *KEY)
    asked = made.select(*KEY, "field").unionByName(made.select("mapper_id", "field").distinct().withColumn("mutant", F.lit("")))
    asked = asked.join(keyed, KEY).join(steps, ["mapper_id", "field"]).drop("mapper_id", "mutant").withColumnRenamed("key", "mapper_id")
    bad = work.keep(audit.ungrounded(asked, texts, by=["mapper_id"]).select(F.col("mapper_id").alias("key"), "field").distinct())
    before = bad.join(keyed.where("mutant = ''"), "key").select("mapper_id", "field", F.lit(True).alias("_before"))
    out = made.join(keyed, KEY).join(states, ["key", "field"], "left").join(bad.withColumn("_now", F.lit(True)), ["key", "field"], "left").join(before, ["mapper_id", "field"], "left")
    outcome = F.when(F.coalesce("state", F.lit("missing")) != "mapped", "demoted").when(F.col("_now") & F.col("_before").isNull(), "ungrounded").otherwise("survived")
    return out.select("mapper_id", "kind", "field", "line", outcome.alias("outcome"))
