"""Versioned results: one row per (mapper_id, fingerprint, target_field)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import leaf
from weftline.operators.keyed import first_by, upsert

#: What a stored field's status may be.
VERIFIED, CORRECTED, PENDING = "verified", "user-corrected", "pending-review"
STATUSES = [VERIFIED, CORRECTED, PENDING]
KEYS = ["mapper_id", "fingerprint", "target_field"]


def leaf_key(name: str) -> Column:
    return F.lower(leaf(F.col(name)))


def upper_kinds(name: str) -> Column:
    """Kinds in capitals; one that is missing is a question mark."""
    return F.transform(name, lambda k: F.upper(F.coalesce(k, F.lit("?"))))


def last_by_leaf(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """by, _k and a value: of the fields of one leaf the last one's, by pos, or by the field's name where there is none."""
    order = [F.col(c) for c in ("pos", "target_field") if c in rows.columns]
    return rows.groupBy(*by, leaf_key("target_field").alias("_k")).agg(F.max_by(value, F.struct(*order)).alias(name))


def compare_golden(golden: DataFrame, current: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Golden rows (by, target_field, kinds) with their outcome against current ones: matched, mismatched or missing. Of equal leaves the last one counts."""
    by = by or []
    now = last_by_leaf(current, by, F.col("kinds"), "found")
    out = golden.withColumn("_k", leaf_key("target_field")).join(now, [*by, "_k"], "left").drop("_k")
    same = upper_kinds("found") == upper_kinds("kinds")
    return out.withColumn("outcome", F.when(F.col("found").isNull(), "missing").when(same, "matched").otherwise("mismatched"))


def diff(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, target_field, k (its leaf), change, old_kinds and new_kinds: a row for each field of the new version, and for each of the old one whose leaf is gone.

    Versions are (by, target_field, kinds, and pos if there is an order). Of equal leaves in the old version the last one is compared.
    """
    by = by or []
    keys = [*by, "_k"]
    a, b = (v.withColumn("_k", leaf_key("target_field")) for v in (old, new))
    before = last_by_leaf(old, by, upper_kinds("kinds"), "old_kinds").withColumn("_there", F.lit(True))
    now = b.select(*keys, "target_field", upper_kinds("kinds").alias("new_kinds")).join(before, keys, "left")
    change = F.when(F.col("_there").isNull(), "added").when(F.col("old_kinds").eqNullSafe(F.col("new_kinds")), "unchanged").otherwise("kinds-changed")
    gone = a.join(b.select(*keys).distinct(), keys, "left_anti").select(*keys, "target_field", F.lit("removed").alias("change"), upper_kinds("kinds").alias("old_kinds"))
    told = now.select(*keys, "target_field", change.alias("change"), "old_kinds", "new_kinds").unionByName(gone, allowMissingColumns=True)
    return told.withColumnRenamed("_k", "k").select(*by, "target_field", "k", "change", "old_kinds", "new_kinds")


def promote(store: DataFrame, labels: DataFrame, now: str) -> DataFrame:
    """Merge labels into the store: corrected rows stay, others are replaced, rows without a label are kept."""
    s, n = store.alias("s"), labels.alias("n")
    on = F.lit(True)
    for k in KEYS:
        on = on & (F.col(f"s.{k}") == F.col(f"n.{k}"))
    keep = F.col("n.target_field").isNull() | (F.coalesce(F.col("s.status"), F.lit("")) == CORRECTED)
    fresh = lambda c: F.col(f"n.{c}") if c in labels.columns else F.lit(None)
    cols = [F.coalesce(f"s.{k}", f"n.{k}").alias(k) for k in KEYS]
    cols += [F.when(keep, F.col(f"s.{c}")).otherwise(fresh(c)).alias(c) for c in store.columns if c not in (*KEYS, "updated_at")]
    if "updated_at" in store.columns:
        cols.append(F.when(keep, F.col("s.updated_at")).otherwise(F.lit(now)).alias("updated_at"))
    return s.join(n, on, "full_outer").select(*cols)


def correct(store: DataFrame, row: DataFrame, now: str | None = None) -> DataFrame:
    """Put corrected fields in the place of their old rows.

    A row's user_claim and judge_evidence become its correction, (user_claim, judge_evidence, corrected_at), and the judge its labeller at that time.
    """
    fixed = row.withColumn("status", F.lit(CORRECTED))
    if {"user_claim", "judge_evidence"} <= {*row.columns}:
        at = F.lit(now)
        record = F.struct("user_claim", "judge_evidence", at.alias("corrected_at"))
        fixed = fixed.withColumn("correction", record).withColumn("labeled_by", F.lit("judge")).withColumn("labeled_at", at).drop("user_claim", "judge_evidence")
        if "updated_at" in store.columns:
            fixed = fixed.withColumn("updated_at", at.cast(store.schema["updated_at"].dataType))
    old = store
    for c in fixed.columns:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast(fixed.schema[c].dataType))
    return upsert(old, fixed, KEYS)


def approve(store: DataFrame, mapper_id: str | None = None) -> DataFrame:
    """Pending rows become verified, of one mapper or of all."""
    mine = F.lit(True) if mapper_id is None else F.col("mapper_id") == mapper_id
    return store.withColumn("status", F.when(mine & (F.col("status") == PENDING), VERIFIED).otherwise(F.col("status")))


def status_counts(store: DataFrame) -> DataFrame:
    """Rows of each status by mapper, 0 where there are none."""
    return store.groupBy("mapper_id").agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES])


def latest_per(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the smallest tie."""
    return first_by(rows, F.col(key), [F.col(at).desc(), F.col(tie)])


def previous(versions: DataFrame, current: DataFrame) -> DataFrame:
    """For each mapper the newest other fingerprint than the current one (mapper_id, fingerprint)."""
    others = versions.join(current, ["mapper_id", "fingerprint"], "left_anti")
    best = F.max(F.struct("updated_at", "fingerprint")).alias("b")
    return others.groupBy("mapper_id").agg(best).select("mapper_id", F.col("b.fingerprint").alias("fingerprint"), F.col("b.updated_at").alias("updated_at"))


def prune(versions: DataFrame, current: DataFrame, keep: int) -> DataFrame:
    """Versions (mapper_id, fingerprint, updated_at) with whether they stay: the current one and the newest keep - 1 others."""
    marked = versions.join(current.withColumn("is_current", F.lit(True)), ["mapper_id", "fingerprint"], "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("mapper_id", "is_current").orderBy(F.desc("updated_at"), "fingerprint"))
    return marked.withColumn("kept", F.col("is_current") | (rank <= keep - 1))


def drift(mappers: DataFrame, versions: DataFrame) -> DataFrame:
    """Mappers (mapper_id, fingerprint: null if the source is gone) with their status against stored versions.

    Two joins by equality, with the versions and with the mappers that have any; no list of fingerprints is gathered.
    """
    more = [F.sum(F.coalesce("corrections", F.lit(0))).alias("corrections")] if "corrections" in versions.columns else []
    known = versions.groupBy("mapper_id").agg(F.lit(True).alias("_any"), *more)
    same = versions.select("mapper_id", "fingerprint").where("fingerprint is not null").distinct().withColumn("_same", F.lit(True))
    out = mappers.join(known, "mapper_id", "left").join(same, ["mapper_id", "fingerprint"], "left")
    status = F.when(F.col("fingerprint").isNull(), "unresolvable").when(F.col("_any").isNull(), "never-verified").when(F.col("_same"), "current").otherwise("stale")
    return out.select(*[c for c in out.columns if c not in ("_any", "_same")], status.alias("status"))


def checklist_view(fields: DataFrame, store: DataFrame, cache: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fields (by, field) with their stored and cached results, by lower-cased leaf; of equal leaves the last one counts."""
    by = by or []
    out = fields.withColumn("_k", leaf_key("field"))
    for side, name in ((store, "stored"), (cache, "cached")):
        out = out.join(last_by_leaf(side, by, F.col("kinds"), name), [*by, "_k"], "left")
    available = F.when(F.col("stored").isNotNull(), "verified").when(F.col("cached").isNotNull(), "cache").otherwise("none")
    return out.withColumn("available", available).drop("_k")


def ci_check(mappers: DataFrame, versions: DataFrame, changed: DataFrame) -> DataFrame:
    """Drift of the mappers that a diff touches; ok while none is stale, also when it touches none."""
    from weftline.operators.keyed import touched

    return drift(touched(mappers, changed), versions).agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "stale").alias("stale")).withColumn("ok", F.col("stale") == 0)
