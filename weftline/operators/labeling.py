"""Labels: from checklists and given answers to results, without a model.

A table of answers stands for the model; what is deterministic around it is here: precedence, demotion, routing, statuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import bean_leaf, leaf, matches_selectors, norm


def filter_steps(steps: Column, selectors: Column) -> Column:
    """Steps (target_field, children) that a selector names; in the place of a parent that none names, its children that one does."""
    none = F.size(selectors) == 0

    def one(s: Column) -> Column:
        kids = F.filter(F.coalesce(s["children"], F.array().cast("array<struct<target_field: string>>")), lambda c: F.coalesce(matches_selectors(c["target_field"], selectors), F.lit(False)))
        own = F.coalesce(matches_selectors(s["target_field"], selectors), F.lit(False))
        alone = F.array(F.struct(s["target_field"].alias("target_field"), kids.alias("children")))
        lifted = F.transform(kids, lambda c: F.struct(c["target_field"].alias("target_field"), F.array().cast("array<struct<target_field: string>>").alias("children")))
        return F.when(own, alone).otherwise(lifted)

    return F.when(none, steps).otherwise(F.flatten(F.transform(steps, one)))


def export_selected(field: Column, selectors: Column) -> Column:
    """The looser test of job exports: the field holds the last part of a selector, in any case."""
    return (F.size(selectors) == 0) | F.exists(selectors, lambda s: F.contains(F.lower(field), F.lower(F.substring_index(s, ".", -1))))


def nested_upsert(slices: DataFrame, extra: DataFrame, by: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Dotted sites (by, line, target_field) upgrade an undotted one of the same line and leaf; where there is a dotted one it stays.

    Of several new sites of one line and leaf the first by ``order``, or else by name, counts. Other columns of either side are kept.
    """
    keys = [*(by or []), "line", "_k"]
    a = slices.withColumn("_k", norm(leaf(F.col("target_field"))))
    more = [c for c in extra.columns if c not in (*keys, "target_field") and c in slices.columns]
    first = F.min(F.struct(*[F.col(order or "target_field").alias("o")], F.col("target_field").alias("name"), *more)).alias("_new")
    b = extra.withColumn("_k", norm(leaf(F.col("target_field")))).groupBy(*keys).agg(first)
    out = a.join(b, keys, "full_outer")
    keep = F.col("target_field").isNotNull() & (F.col("_new").isNull() | F.contains("target_field", F.lit(".")))
    rest = [c for c in slices.columns if c not in (*keys, "target_field")]
    filled = [F.when(F.col("target_field").isNotNull(), F.col(c)).otherwise(F.col(f"_new.{c}") if c in more else F.lit(None)).alias(c) for c in rest]
    return out.select(*keys[:-1], F.when(keep, F.col("target_field")).otherwise(F.col("_new.name")).alias("target_field"), *filled)


def route(fields: DataFrame, slices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fields (by, field) with the slice text of their own key, else of the lower-cased leaf (which only finds lower-case keys), else of a suffix."""
    by = by or []
    exact = slices.select(*by, F.col("field").alias("_key"), F.col("text").alias("_exact"))
    low = exact.select(*by, F.col("_key").alias("_t"), F.col("_exact").alias("_low"))
    suffix = exact.groupBy(*by, F.lower(F.substring_index("_key", ".", -1)).alias("_t")).agg(F.min_by("_exact", "_key").alias("_suffix"))
    out = fields.withColumn("_key", F.col("field")).withColumn("_t", F.lower(F.substring_index("field", ".", -1)))
    out = out.join(exact, [*by, "_key"], "left").join(low, [*by, "_t"], "left").join(suffix, [*by, "_t"], "left")
    return out.select(*fields.columns, F.coalesce("_exact", "_low", "_suffix").alias("text"))


def resolve_labels(fields: DataFrame, verified: DataFrame, cache: DataFrame, answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each field (by, field, state) with its pipeline and where it is from: verified, cache, then an answer that isn't empty.

    Unmapped fields need no label; a mapped field without one turns unresolved.
    """
    out, keys = fields, [*(by or []), "field"]
    for name, side in (("verified", verified), ("cache", cache), ("model", answers.where(F.size("pipeline") > 0))):
        out = out.join(side.select(*keys, F.col("pipeline").alias(f"_{name}")), keys, "left")
    names = ["verified", "cache", "model"]
    found = F.coalesce(*[F.col(f"_{n}") for n in names])
    source = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names])
    mapped = F.col("state") == "mapped"
    out = out.withColumn("pipeline", F.when(mapped, found)).withColumn("source", F.when(mapped, source))
    return out.withColumn("state", F.when(mapped & found.isNull(), "unresolved").otherwise(F.col("state"))).drop(*[f"_{n}" for n in names])


#: Fixed value: rounds of tools that an investigation may take.
TOOL_ROUNDS = 6
ANSWER = ("recognised", "pipeline")


def label_rounds(tasks: DataFrame, answers: DataFrame, tools: DataFrame | None = None, escalations: int = 1, by: list[str] | None = None) -> DataFrame:
    """by, field, state, source, attempts, tool_calls, tool_ok and pipeline: how every task is settled by the answers that are given.

    tasks: (by, field, state); answers: (by, field, attempt from 0, recognised, pipeline); tools: (by, field, round from 0, tool, recognised, pipeline), a
    null tool being the answer. A mapped task is asked with its slice and once more with the full source, an unresolved one with the full source, at first
    and at each escalation. The first recognised answer that has steps ends it; else the last one counts. An unresolved task that is still
    not recognised is given to the tools, for at most six rounds. What has no steps then is never accepted: it stays unresolved. Unmapped tasks aren't asked.
    """
    keys = [*(by or []), "field"]
    asked = tasks.where(F.col("state").isin("mapped", "unresolved")).withColumn("_most", F.when(F.col("state") == "unresolved", escalations).otherwise(1))
    given = F.struct("attempt", *ANSWER)
    good = F.coalesce(F.col("recognised") & (F.size("pipeline") > 0), F.lit(False))
    met = answers.join(asked.select(*keys, "_most"), keys).where(F.col("attempt") <= F.col("_most"))
    said = met.groupBy(*keys).agg(F.min(F.when(good, F.struct("attempt", "pipeline"))).alias("_good"), F.max_by(given, "attempt").alias("_last"))
    out = asked.join(said, keys, "left")
    known = F.coalesce(F.col("_good").isNotNull() | F.col("_last")["recognised"], F.lit(False))
    out = out.withColumn("_known", known).withColumn("_tools", F.lit(None).cast("struct<n: bigint, recognised: boolean, pipeline: array<string>>") if tools is None else F.lit(None))
    if tools is not None:
        within = tools.where(F.col("round") < TOOL_ROUNDS)
        final = within.groupBy(*keys).agg(F.min(F.when(F.col("tool").isNull(), F.col("round"))).alias("_end"))
        shown = within.join(final, keys).where(F.col("_end").isNull() | (F.col("round") <= F.col("_end")))
        shown = shown.groupBy(*keys).agg(F.struct(F.count("tool").alias("n"), F.max_by(F.struct(*ANSWER), "round").alias("a"), F.max("_end").isNotNull().alias("ended")).alias("_tools"))
        out = out.drop("_tools").join(shown, keys, "left")
        tried = (F.col("state") == "unresolved") & ~F.col("_known")
        ended = F.coalesce(tried & F.col("_tools.ended"), F.lit(False))
        tool_ok, calls = F.coalesce(ended & F.col("_tools.a.recognised"), F.lit(False)), F.when(tried, F.coalesce("_tools.n", F.lit(0))).otherwise(0)
        found = F.when(tool_ok, F.col("_tools.a.pipeline")).when(~ended, F.col("_good.pipeline"))
    else:
        tool_ok, calls, found = F.lit(False), F.lit(0), F.col("_good.pipeline")
    out = out.withColumn("tool_ok", tool_ok).withColumn("tool_calls", calls.cast("long")).withColumn("pipeline", F.when(F.size(found) > 0, found))
    at = F.col("_good.attempt")
    source = F.when(F.col("pipeline").isNull(), None).when(F.col("tool_ok"), "tools").when((F.col("state") == "mapped") & (at == 0), "slice").when(at == 0, "full source").otherwise("escalation")
    attempts = F.when(at.isNotNull(), at + 1).otherwise(F.col("_most") + 1).cast("int")
    out = out.withColumn("source", source).withColumn("attempts", attempts).withColumn("state", F.when(F.col("pipeline").isNull(), "unresolved").otherwise("mapped"))
    return out.select(*keys, "state", "source", "attempts", "tool_calls", "tool_ok", "pipeline")


def result_source(resolved: DataFrame, by: str) -> DataFrame:
    """verified, cache, model or mixed for each mapper, and how many fields came from where."""
    n = resolved.groupBy(by).agg(*[F.count(F.when(F.col("source") == s, 1)).alias(s) for s in ("verified", "cache", "model")])
    kinds = sum((F.col(s) > 0).cast("int") for s in ("verified", "cache", "model"))
    return n.withColumn("result_source", F.when(kinds > 1, "mixed").when(F.col("verified") > 0, "verified").when(F.col("cache") > 0, "cache").when(F.col("model") > 0, "model"))


def label_all(mappers: DataFrame, store: DataFrame, labels: DataFrame, model: bool) -> DataFrame:
    """Status of a batch run for every mapper: verified, labeled, needs-model, or error where the source is gone."""
    known = store.select("mapper_id", "fingerprint").distinct().withColumn("_v", F.lit(True))
    done = labels.select("mapper_id").distinct().withColumn("_l", F.lit(True))
    out = mappers.join(known, ["mapper_id", "fingerprint"], "left").join(done, "mapper_id", "left")
    status = F.when(F.col("fingerprint").isNull(), "error").when(F.col("_v"), "verified").when(F.lit(model) & F.col("_l"), "labeled").when(F.lit(model), "error").otherwise("needs-model")
    return out.withColumn("status", status).drop("_v", "_l")


def count_diagnostics(diagnostics: Column, prefix: str) -> Column:
    return F.size(F.filter(diagnostics, lambda d: F.startswith(d, F.lit(prefix))))


def discovered(claims: DataFrame, confidence: float = 0.6, by: list[str] | None = None) -> DataFrame:
    """Claims (by, field, pos) without repeats of a bean leaf, the first one kept, with a fixed confidence."""
    n = F.row_number().over(Window.partitionBy(*(by or []), bean_leaf(F.col("field"))).orderBy("pos"))
    return claims.withColumn("_n", n).where("_n = 1").drop("_n").withColumn("confidence", F.lit(confidence))


def fallback_checklist(sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A checklist from the writes themselves, for targets without declared fields; it can't show unmapped ones."""
    by = by or []
    first = sites.groupBy(*by, norm(F.col("target_field")).alias("_k")).agg(F.min(F.struct("line", "target_field")).alias("_f"))
    return first.select(*by, F.col("_f.target_field").alias("field"), F.lit("mapped").alias("state"))


def diverging(first: DataFrame, second: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fields (by, field) whose two pipelines (signatures in order) differ."""
    keys = [*(by or []), "field"]
    a, b = first.select(*keys, F.col("signatures").alias("_a")), second.select(*keys, F.col("signatures").alias("_b"))
    return a.join(b, keys).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def critic_findings(findings: DataFrame, slices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Missing steps (by, field, evidence) that a critic claims, where the slice has what is cited."""
    from weftline.functions.text import verified_citation

    return findings.join(slices, [*(by or []), "field"]).where(verified_citation(F.col("evidence"), F.col("text"))).drop("text")


def label_from_cache(fields: DataFrame, verified: DataFrame, cache: DataFrame, current: DataFrame, selectors: DataFrame | None = None) -> DataFrame:
    """Fields (mapper_id, field) with a pipeline from what is stored, without a model, and where it is from.

    Verified rows (mapper_id, fingerprint, field, pipeline) of the current fingerprint come first, then cached ones
    (mapper_id, fingerprint, field, pipeline, updated_at) of it, of several the newest, then those of the newest other fingerprint that has the field. Of
    selectors (mapper_id, selector) each has to be covered by a field that has a pipeline; else it is an error that names one.
    """
    keys = ["mapper_id", "field"]
    here = current.select("mapper_id", "fingerprint")
    a = verified.join(here, ["mapper_id", "fingerprint"]).groupBy(*keys).agg(F.max_by("pipeline", F.struct(*[c for c in ("updated_at", "pipeline") if c in verified.columns])).alias("_verified"))
    b = cache.join(here, ["mapper_id", "fingerprint"]).groupBy(*keys).agg(F.max_by("pipeline", "updated_at").alias("_cache"))
    rest = cache.join(here, ["mapper_id", "fingerprint"], "left_anti")
    c = rest.groupBy(*keys).agg(F.max_by("pipeline", F.struct("updated_at", "fingerprint")).alias("_older"))
    out = fields.join(a, keys, "left").join(b, keys, "left").join(c, keys, "left")
    names = ["verified", "cache", "older"]
    out = out.withColumn("pipeline", F.coalesce(*[F.col(f"_{n}") for n in names])).withColumn("source", F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names])).drop(*[f"_{n}" for n in names])
    if selectors is not None:
        covered = out.where("pipeline is not null").groupBy("mapper_id").agg(F.collect_set("field").alias("_fields"))  # a mapper's own fields
        open_ = selectors.join(covered, "mapper_id", "left").where(~F.coalesce(F.exists("_fields", lambda f: matches_selectors(f, F.array("selector"))), F.lit(False)))
        lost = open_.select("mapper_id", "selector").first()
        if lost:
            raise ValueError(f"{lost.mapper_id}: nothing stored covers {lost.selector}")
    return out
