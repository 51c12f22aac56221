"""Joins that the engine lacks by name: fallback keys, intervals, segments, division, upserts.

All keep an equality in the join where there is one, so the engine can hash or merge; ranges are residual conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, value: str, id_cols: list[str]) -> DataFrame:
    """Points with ``value`` of the smallest span that holds them; null where none does. Aggregated, so no window sorts a file's points.

    An index of whole numbers in powers of eight: a span of up to 2**z places, z being the next multiple of three, is listed under the cells of 2**z places
    that it touches, one or two, and a point looks under its own cell of every z that occurs, of at most 21. So it is a join by equality of (file, z, cell), its
    sides grow with the points and the spans, and a point is few rows; what meets in a cell and doesn't hold the point goes within the join.
    """
    bits = F.length(F.bin((F.col(end) - F.col(start)).cast("long")))
    s = spans.where(F.col(end) >= F.col(start)).withColumn("_z", F.least(F.ceil(bits / 3) * 3, F.lit(63)).cast("int"))
    cells = F.array_distinct(F.array(*[F.expr(f"shiftright(cast(`{c}` as bigint), _z)") for c in (start, end)]))
    s = s.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(value).alias("_value"), "_z", F.explode(cells).alias("_cell"))
    sizes = [r[0] for r in s.select("_z").distinct().collect()]
    p = points.withColumn("_pz", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("_pc", F.expr(f"shiftright(cast(`{at}` as bigint), _pz)"))
    cond = (F.col("_pz") == F.col("_z")) & (F.col("_pc") == F.col("_cell")) & F.col(at).between(F.col("_start"), F.col("_end"))
    for c in on:
        cond = (F.col(c) == F.col(f"_{c}")) & cond
    hit = F.struct((F.col("_end") - F.col("_start")).alias("width"), F.col("_start").alias("start"), F.col("_value").alias("value")).alias("_hit")
    found = p.join(s, cond).select(*id_cols, hit)
    none = points.select(*id_cols, F.lit(None).cast(found.schema["_hit"].dataType).alias("_hit"))
    return found.unionByName(none).groupBy(*id_cols).agg(F.min("_hit").alias("_hit")).select(*id_cols, F.col("_hit.value").alias(value))


def segments(events: DataFrame, by: list[str], order: list[str], opens: Column) -> DataFrame:
    """Events with the number of the lifetime segment they are in: how often ``opens`` was true up to them; 0 before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(w))


def attribute(writes: DataFrame, injections: DataFrame, by: list[str], parent: str, parents: DataFrame | None = None) -> DataFrame:
    """Writes with the parents that an injection in their segment names, a row each, and whether the write is attributed: to one.

    A write whose segment names several parents taints each of them; one that no injection names taints all ``parents`` (by,
    parent) of its key where they are given, else its parent is null.
    """
    named = injections.select(*by, "segment", parent).distinct()
    n = named.groupBy(*by, "segment").agg(F.count("*").alias("_n"))
    out = writes.join(n, [*by, "segment"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    hit = out.where("_n > 0").join(named, [*by, "segment"])
    rest = out.where("_n = 0")
    rest = rest.withColumn(parent, F.lit(None).cast(injections.schema[parent].dataType)) if parents is None else rest.join(parents.select(*by, parent).distinct(), by, "left")
    return hit.unionByName(rest.select(*hit.columns)).withColumn("attributed", F.col("_n") == 1).drop("_n")


def builder_sites(sites: DataFrame, chains: DataFrame, by: list[str], at: str = "line", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Sites with every builder chain (by, var, start, end) that is open at them; chains of one key are few, as they are in one file."""
    c = chains.select(*by, "var", F.col(start).alias("_start"), F.col(end).alias("_end"))
    return sites.join(c, by).where(F.col(at).between(F.col("_start"), F.col("_end"))).drop("_start", "_end")


def touched(mappers: DataFrame, changed: DataFrame, source: str = "source_file", path: str = "path") -> DataFrame:
    """Mappers whose source is among the changed paths: the path holds the source, or the source ends with the path.

    Both are joins by equality over distinct names: every ending of a source with a path; and the last k letters of a source, k being the largest power of two
    that its length holds, with every k letters in a row of a path. So a short source is looked up as such and makes no longer one meet more paths.
    """
    names = mappers.select(F.col(source).alias("_s")).where("_s is not null").distinct()
    paths = changed.select(F.col(path).alias("_p")).where("_p is not null").distinct()
    sized = names.withColumn("_c", F.when(F.col("_s") != "", F.length(F.bin(F.length("_s").cast("long"))) - 1).otherwise(-1))
    sizes = [r[0] for r in sized.select("_c").distinct().collect()]  # at most 32 numbers
    sized = sized.withColumn("_k", F.expr("case when _c < 0 then '' else right(_s, shiftleft(1, _c)) end"))
    grams = paths.withColumn("_c", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("_w", F.expr("shiftleft(1, greatest(_c, 0))"))
    every = F.expr("case when _c < 0 then array('') when length(_p) >= _w then array_distinct(transform(sequence(1, length(_p) - _w + 1), i -> substr(_p, i, _w))) end")
    grams = grams.select("_p", "_c", F.explode(every).alias("_k"))
    held = sized.join(grams, ["_c", "_k"]).where(F.contains("_p", F.col("_s"))).select("_s")
    ends = names.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_s"), F.lit(1))), lambda i: F.expr("_s").substr(i, F.lit(2**31 - 1)))))
    hit = held.unionByName(ends.join(paths, "_p", "left_semi").select("_s")).distinct()
    return mappers.join(hit, F.col(source) == F.col("_s"), "left_semi")


def changed(mappers: DataFrame, paths: DataFrame, source: str = "source_file", path: str = "path") -> DataFrame:
    """Mappers whose source is one of the paths, exactly."""
    return mappers.join(paths.select(F.col(path).alias(source)).distinct(), source, "left_semi")


def uncovered(selectors: DataFrame, fields: DataFrame, key: Column, other: Column) -> DataFrame:
    """Selectors that no field covers; empty if the division holds."""
    return selectors.withColumn("_k", key).join(fields.select(other.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All new rows, and the old ones whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def first_by(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def top_per(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """At most k rows of each group, in order. The engine limits each task's groups before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
