"""What the near-duplicate operators share: whole groups in an Arrow stream, links within them, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Call ``fn`` on tables of whole groups of the long column ``key``, sorted by it.

    Many small groups come in one table. A task holds one batch and one group, whose size the caller bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # where the last group of the batch begins
            if cut or (held and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != keys[0]):
                yield from fn(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds [a, b) of the runs of equal keys."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b reach."""
    out = np.arange(n)
    while True:
        x, y = out[a], out[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            return out
        np.minimum.at(out, high[open_], low[open_])
        while (further := out[out]).tobytes() != out.tobytes():
            out = further


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and root, the smallest node of its component, for all nodes of the edges (a, b: long).

    Each task first contracts its own edges; then large and small stars alternate until nothing changes. Each round is a
    written table, and what it moves is in proportion to the edges.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = labels(at[: len(a)], at[len(a) :], len(nodes))
            own = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])

    now = scratch.keep(edges.select("a", "b").where("a <> b").mapInArrow(contract, "a long, b long").distinct(), f"{name}0")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    k = 0
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("b", "m").where("b <> m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        k += 1
        now = scratch.keep(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        old, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old == mark:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def connect(rows: DataFrame, most: int, weight: int, run: Callable[[DataFrame], DataFrame], scratch: Scratch, name: str) -> tuple[DataFrame, bool]:
    """Edges (a, b) that connect the keys of each group wherever any of its pairs does; and whether groups met whole, in one unit each.

    ``rows`` has group, key, n and w (the group's rows and weight); ``run`` finds edges within units (unit, part, key, root), where
    rows of two parts meet across only and rows of one root are connected already. A unit has about ``most`` rows and ``weight``.

    A group within these bounds is one unit. A larger one is dealt into blocks, twice and at random, which connects what
    hangs together well at a cost in proportion to the group. What then is not in the group's largest component meets all of
    the group, block by block. So every pair is either connected or compared, as in a small group, and only stragglers cost more.
    """
    blocks = F.ceil(F.greatest(F.col("n") / most, F.col("w") / weight)).cast("int")
    dealt = rows.select("group", "key", blocks.alias("blocks"))
    large = dealt.where("blocks > 1")
    units = dealt.where("blocks <= 1").select(F.col("group").alias("unit"), F.lit(0).alias("part"), "key", F.col("key").alias("root"))
    if large.isEmpty():
        return scratch.keep(run(units), name), True
    for deal in (1, 2):
        block = F.pmod(F.xxhash64("key", F.lit(deal)), F.ceil(F.col("blocks") * 1.1))
        units = units.unionByName(large.select(F.xxhash64("group", F.lit(deal), block).alias("unit"), F.lit(0).alias("part"), "key", F.col("key").alias("root")))
    first = scratch.keep(run(units), f"{name}-deals")
    roots = components(first, scratch, f"{name}-star")
    state = large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    state = scratch.keep(state, f"{name}-state")
    by_root = state.groupBy("group", "root").agg(F.count("*").alias("c"))
    main = by_root.groupBy("group").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("c"))
    main = scratch.keep(main.where("c < n").select("group", "main", (F.col("n") - F.col("c")).alias("others"), "n"), f"{name}-main")
    if main.isEmpty():
        return first, False
    state = state.join(main, "group")
    # as many blocks of stragglers as their share of the group's, and twice the group's own, so that two fit in a unit
    state = state.withColumn("theirs", F.ceil(2.2 * F.col("blocks") * F.col("others") / F.col("n")).cast("int")).withColumn("own", F.ceil(2.2 * F.col("blocks")).cast("int"))
    unit = F.xxhash64("group", "i", "j").alias("unit")
    away = state.where("root <> main").withColumn("i", F.pmod(F.xxhash64("key", F.lit(3)), F.col("theirs")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    every = state.withColumn("j", F.pmod(F.xxhash64("key", F.lit(4)), F.col("own")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    units = away.select(unit, F.lit(0).alias("part"), "key", "root").unionByName(every.select(unit, F.lit(1).alias("part"), "key", "root"))
    return first.unionByName(scratch.keep(run(units), f"{name}-rest")), False


def block_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """Units of at most about ``limit`` rows for rows (group, key, n: rows of the group): unit and part.

    A small group is one unit. A larger one is dealt into blocks of half the limit, and each pair of blocks is a unit,
    so that every pair of rows meets and no task holds the group. Units whose rows differ in part compare across only.
    """
    blocks = F.when(F.col("n") > limit, F.ceil(F.col("n") * 2.2 / limit)).otherwise(1).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("key", F.lit(11)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.when(F.col("blocks") == 1, F.col("group")).otherwise(F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")))
    return dealt.withColumn("unit", unit).drop("blocks", "other", "n")
