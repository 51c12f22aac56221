"""Operator 3: mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target of words by its weight; a target stops at ``cap`` times the source's size and the excess is
shared again by weight among the others, which is solved at once from running sums over the sources. With r = target /
size, each document of a source is taken floor(r) times for certain. What is left of the target is given by a sample of
unequal probabilities: a document's inclusion probability is p = min(1, level * size ** tilt), or level times a column of
prior weights, where the level makes the expected words of the sample exactly what is left. Documents that reach 1 are whole
copies for certain; each other document has the rank (U / (1 - U)) / (p / (1 - p)), where U is drawn from a hash of its id.

The sample's size is fixed in words: documents are taken in the order of their ranks as long as their running sum stays
within what is left. Only the one document at the boundary is then settled by its size: of all that are not taken, the one
that comes nearest to the words still missing, if it comes nearer than none does. ``tilt`` is 1/8: of two documents the one
with 256 times the words is twice as likely, so that long documents, which make a sum in words uneven, are rather settled first.

Running sums never sort a source: intervals of ranks are summed first, then parts of the interval in which the sum ends, and
only one part is ordered. The decision is a table of thresholds with one row per source, so documents need no shuffle to
apply it.

Defined results: null text has size 0; the null source is a source of its own, the last one; a source without words has
target 0. Rows alike in id and size share one rank and are taken together or not at all, so reruns agree. A null id
ranks as the empty id. An empty table gives an empty result. Columns of the input with the names of results are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP, SEED, INTERVALS = (3, 1, 2), 1.5, 2.0, "mix-1", 4096
BROADCAST_SOURCES = 10_000


def tilted() -> Column:
    """size ** (1 / 8), by roots that are exact to the last bit in every engine."""
    return F.sqrt(F.sqrt(F.sqrt(F.col("size").cast("double"))))


def _drawn(seed: str, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """name (id as text), source, size and u, a number drawn from (0, 1)."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), name), 256), 1, 12), 16, 10).cast("double")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return [name.alias("name"), F.col(source_col).alias("source"), size.alias("size"), ((drawn + 0.5) / float(2**48)).alias("u")]


def sized(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The id with name, source, size and u of each row."""
    return docs.select(F.col(id_col), *_drawn(seed, id_col, text_col, source_col))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, base (certain copies) and rest (words that the sample has to give).

    One row per source is sorted in one task; that is the number of sources, not of documents.
    """
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("w", F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int"))).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    each = each.select("*", F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"), (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left"), F.row_number().over(order).alias("k"), (share * F.sum("source_size").over(whole)).alias("total"))
    level = (F.col("total") - F.col("full")) / F.col("left")
    each = each.withColumn("level", F.min(F.when(level <= F.col("most") / F.col("w"), F.struct("k", level.alias("level")))).over(whole)["level"])
    each = each.withColumn("target", F.coalesce(F.least("most", F.col("w") * F.col("level")), "most"))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    each = each.withColumn("base", F.floor(ratio))
    return each.select("source", "source_size", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("rest"))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join each row with its source's row of the plan, broadcast while sources are counted to be few."""
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "plan_source")
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def joined(plan: DataFrame, side: DataFrame) -> DataFrame:
    """The plan with the columns of ``side``, which has at most one row of a source."""
    side = side.withColumnRenamed("source", "side_source")
    return plan.join(side, F.col("source").eqNullSafe(F.col("side_source")), "left").drop("side_source")


def levels(rows: DataFrame, plan: DataFrame, prior: Column) -> DataFrame:
    """source and level: inclusion probabilities min(1, level * prior) that give ``rest`` words in expectation.

    Documents are counted by their prior first; then the largest prior that stays below certainty is found from running sums, over
    the distinct priors of a source.
    """
    kinds = rows.withColumn("prior", prior).where("size > 0 and prior > 0").groupBy("source", "prior").agg(F.sum("size").alias("words"))
    kinds = with_plan(kinds, plan.select("source", "rest"))
    above = Window.partitionBy("source").orderBy(F.col("prior").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("prior").rowsBetween(Window.unboundedPreceding, 0)
    level = F.try_divide(F.col("rest") - F.coalesce(F.sum("words").over(above), F.lit(0)), F.sum(F.col("words") * F.col("prior")).over(upto))
    kinds = kinds.withColumn("level", level).where(F.col("level") * F.col("prior") <= 1)
    return kinds.groupBy("source").agg(F.max_by("level", "prior").alias("level"))


def ranked(rows: DataFrame, prior: Column | None = None) -> DataFrame:
    """Rows joined with a plan that has levels: p, rank (random odds over inclusion odds, null where p is 0), and the rank's interval and part.

    1 - 1 / (1 + rank) maps ranks to [0, 1) in the same order.
    """
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("level") * (tilted() if prior is None else prior), F.lit(0.0))))
    rows = rows.withColumn("p", F.when((F.col("rest") > 0) & (F.col("size") > 0), F.when(F.col("level").isNull(), 1.0).otherwise(p)).otherwise(0.0))
    rows = rows.withColumn("rank", F.try_divide(F.col("u") * (1 - F.col("p")), (1 - F.col("u")) * F.col("p")))
    at = INTERVALS * (1 - 1 / (1 + F.col("rank")))
    return rows.withColumn("interval", F.floor(at).cast("int")).withColumn("part", F.floor(INTERVALS * (at - F.floor(at))).cast("int"))


KEY = ("rank", "name", "size")


def sampled(extra: bool = True) -> Column:
    """Whether a row joined with the plan is sampled: certain, of low rank, or the one at the boundary."""
    place, end = F.struct("interval", "part", *KEY), F.col("last")
    open_ = F.coalesce((F.col("p") > 0) & (place <= end), F.lit(False))
    taken = (F.col("p") >= 1) | open_
    return taken | F.coalesce((F.col("p") > 0) & (F.struct(*KEY) == F.col("extra")), F.lit(False)) if extra else taken


def allocate(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, prior: Column | None = None) -> DataFrame:
    """The plan: targets, levels, and up to which rank (``last``) and with which document beside (``extra``) a source is sampled."""
    plan = scratch.keep(targets(rows, weights, share, cap), "targets")
    plan = scratch.keep(joined(plan, levels(rows, plan, tilted() if prior is None else prior)), "levels")
    drawn = ranked(with_plan(rows, plan), prior)
    sure = drawn.where("p >= 1").groupBy("source").agg(F.sum("size").alias("sure"))
    plan = scratch.keep(joined(plan, sure).withColumn("below", F.coalesce("sure", F.lit(0))).drop("sure"), "sure")
    drawn = ranked(with_plan(rows, plan), prior).where("p > 0 and p < 1")
    found: list[str] = []
    for by in ("interval", "part"):
        # the interval, and then the part of it, in which the running sum passes what is left; if there is none, all are taken
        sums = drawn.groupBy("source", by, "rest", "below").agg(F.sum("size").alias("words"))
        upto = F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        ends = sums.withColumn("upto", upto).groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct(by, (F.col("upto") - F.col("words")).alias("under")))).alias("end"), F.max("upto").alias("all"))
        ends = ends.select("source", F.coalesce(f"end.{by}", F.lit(INTERVALS)).alias(f"{by}_end"), F.coalesce("end.under", "all").alias("under"))
        plan = scratch.keep(joined(plan, ends).withColumn("below", F.coalesce("under", "below")).drop("under"), by)
        found.append(by)
        drawn = ranked(with_plan(rows, plan), prior).where("p > 0 and p < 1").where(" and ".join(f"{x} = {x}_end" for x in found))
    run = F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy(*KEY))
    inside = drawn.select("source", "size", *KEY[:2], (run <= F.col("rest")).alias("in")).where("in")
    last = inside.groupBy("source").agg(F.max(F.struct(*KEY)).alias("edge"), F.sum("size").alias("edge_words"))
    plan = joined(plan, last)
    none = F.struct(F.lit(float("-inf")).alias("rank"), F.lit("").alias("name"), F.lit(0).cast("long").alias("size"))
    edge = F.coalesce("edge", none)
    plan = plan.withColumn("last", F.when(F.col("interval_end").isNotNull(), F.struct(F.col("interval_end").alias("interval"), F.coalesce("part_end", F.lit(INTERVALS)).alias("part"), edge["rank"].alias("rank"), edge["name"].alias("name"), edge["size"].alias("size"))))
    plan = plan.withColumn("gap", F.col("rest") - F.col("below") - F.coalesce("edge_words", F.lit(0)))
    plan = scratch.keep(plan.select("source", "source_size", "target", "base", "rest", "level", "last", "gap"), "last")
    left = ranked(with_plan(rows, plan), prior).where("p > 0").where(~sampled(extra=False))
    off = F.abs(F.col("size") - F.col("gap"))
    near = left.where(off < F.col("gap")).groupBy("source").agg(F.min_by(F.struct(*KEY), F.struct(off, *KEY)).alias("extra"))
    plan = scratch.keep(joined(plan, near), "near")
    # rows alike in id and size come together, so it counts how many they are
    alike = with_plan(rows, plan).where("extra is not null and name = extra.name and size = extra.size").groupBy("source").agg(F.count("*").alias("alike"))
    kept = F.when(F.abs(F.col("alike") * F.col("extra.size") - F.col("gap")) < F.col("gap"), F.col("extra"))
    return scratch.keep(joined(plan, alike).withColumn("extra", kept).drop("alike", "gap"), "plan")


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken (words, repeats counted) and copies of every row."""
    rows = scratch.keep(sized(docs, seed, id_col, text_col, source_col), "sized")
    plan = allocate(rows, scratch, weights, share, cap)
    out = ranked(with_plan(rows, plan)).withColumn("copies", F.col("base") + F.when(sampled(), 1).otherwise(0))
    return out.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeated(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Only thresholds travel, documents do not."""
    plan = allocate(scratch.keep(sized(docs, SEED, id_col, text_col, source_col), "sized"), scratch)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    flat = rows.select("doc", *_drawn(SEED, f"doc.{id_col}", f"doc.{text_col}", f"doc.{source_col}"))
    out = ranked(with_plan(flat, plan)).withColumn("copies", F.col("base") + F.when(sampled(), 1).otherwise(0))
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
