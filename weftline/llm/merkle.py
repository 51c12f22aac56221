"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

A row's leaf is a digest of its columns. Leaves stand in a tree for each group (a language), in the order of their ids; every
``FAN`` nodes in a row become one, until one is left, the group's subroot. Subroots, in the order of their groups, stand in a
tree of the same kind, whose root names the whole table.

Trees are traversed block by block: ``FAN ** HEIGHT`` nodes, aligned, are one unit of a task. ``walk`` is a recursive postorder
traversal that returns a subtree's digest and appends siblings to the leaves it contains while it unwinds. The roots of the
blocks are the nodes of the next, distributed traversal, until every group has one. Then the paths go down: a block's own path to the root
meets its nodes, which are traversed once more, now for their siblings. A row's siblings never leave its task: proofs are
digested, and rows are verified, where the traversal is. Only digests and ids are shuffled, texts never.

Places in a group come from a range sort and counts of its partitions, so a group of any size is one of many tasks.

Defined results: ids ascend, null ids first, rows alike in id by their leaf, repeated rows are leaves of their own; null values
have a mark of their own, unlike an empty text; groups ascend bytewise, null first. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, few

#: Nodes that become one, and levels that one task traverses: 4,096 nodes.
FAN, HEIGHT = 8, 4
#: What a row of a level has: its tree, its place in it, and its digest (lowercase hex).
NODE = "tree long, pos long, digest string"
#: A node's path: by level upwards the digests of its siblings to the left and to the right.
PATH = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(col: Column) -> Column:
    """A value in a leaf: its bytes counted and told, or a mark for null."""
    text = col.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def walk(nodes: list[str], height: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of the tree of this height over the nodes, and every node's siblings upwards, as digests to the left and right of it."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]

    def visit(start: int, level: int) -> str:
        if not level:
            return nodes[start]
        step, end = FAN ** (level - 1), min(start + FAN**level, len(nodes))
        begins = range(start, end, step)
        kids = [visit(k, level - 1) for k in begins]
        for i, k in enumerate(begins):
            beside = ("".join(kids[:i]), "".join(kids[i + 1 :]))
            for own in range(k, min(k + step, end)):
                paths[own].append(beside)
        return digest("".join(kids))

    return visit(0, height), paths


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def least_height(n: int) -> int:
    height = 0
    while FAN**height < n:
        height += 1
    return height


def placed(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with tree (the group's place among the groups), pos (the row's place in its group) and size (the group's rows).

    Rows are sorted by ranges and written with their partition's number; what is counted has a row for each partition and group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(group), *map(F.col, order)]
    own = scratch.keep(rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), name)
    counts = own.groupBy("part", group).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    upto = Window.partitionBy(group).orderBy("part")
    counts = counts.select("part", group, "first", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("size"))
    # one row for each group is ordered in one task
    groups = scratch.keep(counts.select(group, "size").distinct(), f"{name}-groups")
    groups = groups.select(F.col(group).alias("of"), (F.row_number().over(Window.orderBy(group)) - 1).cast("long").alias("tree"))
    counts = scratch.keep(counts.join(groups, F.col(group).eqNullSafe(F.col("of"))).select(F.col("part").alias("at"), "of", "first", "before", "size", "tree"), f"{name}-counts")
    met = own.join(F.broadcast(counts) if few(counts) else counts, (F.col("part") == F.col("at")) & F.col(group).eqNullSafe(F.col("of")))
    return met.withColumn("pos", F.col("row") - F.col("first") + F.col("before")).drop("part", "row", "at", "of", "first", "before")


def blocks() -> Column:
    return F.floor(F.col("pos") / FAN**HEIGHT).cast("long")


def level_up(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks of nodes (tree, pos, digest, size): nodes of the next level, with its size."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size, at = table["size"][0].as_py(), table["pos"][0].as_py() // FAN**HEIGHT
        above = -(-size // FAN**HEIGHT)
        root, _ = walk(table["digest"].to_pylist(), HEIGHT if above > 1 else least_height(size))
        return pa.table({"tree": table["tree"][:1], "pos": pa.array([at], pa.int64()), "digest": [root], "size": pa.array([above], pa.int64())})

    return nodes.select("tree", "pos", "digest", "size").groupBy("tree", blocks().alias("block")).applyInArrow(run, f"{NODE}, size long")


def traverse(nodes: DataFrame, above: DataFrame, extra: str, made: Callable[[pa.Table, dict, list], pa.Table], schema: str) -> DataFrame:
    """What ``made`` makes of each block of nodes, of the row of the block's root in ``above`` (tree, pos, subroot, path) and of the nodes' whole paths.

    ``extra`` are further columns of the nodes that it needs.
    """

    def run(table: pa.Table, roots: pa.Table) -> pa.Table:
        table, top = table.sort_by("pos"), roots.to_pylist()[0]
        size = table["size"][0].as_py()
        _, paths = walk(table["digest"].to_pylist(), HEIGHT if size > FAN**HEIGHT else least_height(size))
        on = [(s["left"], s["right"]) for s in top["path"]]
        return made(table, top, [p + on for p in paths])

    left = nodes.select("tree", "pos", "digest", "size", *extra.split()).groupBy("tree", blocks().alias("block"))
    return left.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(run, schema)


def levels(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables of ``nodes`` (tree, pos, digest, size) and of the nodes of every level above; in the last each tree has one node."""
    out = [nodes]
    while len(out) == 1 or not out[-1].where("size > 1").isEmpty():
        out.append(scratch.keep(level_up(out[-1]), f"{name}-{len(out)}"))
    return out


def paths_down(tops: DataFrame, trees: list[DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """tree, pos, subroot and path of the nodes of the lowest of the levels ``trees``, from those of the highest."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def made(table: pa.Table, top: dict, paths: list) -> pa.Table:
        steps = [[{"left": a, "right": b} for a, b in p] for p in paths]
        return pa.table({"tree": table["tree"], "pos": table["pos"], "subroot": pa.array([top["subroot"]] * len(table), pa.string()), "path": pa.array(steps, kind)})

    for k in range(len(trees) - 2, -1, -1):
        tops = scratch.keep(traverse(trees[k], tops, "", made, f"tree long, pos long, subroot string, path {PATH}"), f"{name}-paths-{k}")
    return tops


def manifest(docs: DataFrame, scratch: Scratch, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", id_col: str = "doc_id", found: dict[str, Column] | None = None) -> DataFrame:
    """Each row's id, leaf, subroot, root, proof_sha256, folded_root and verified.

    proof_sha256 is the digest of the row's siblings, level by level, left to right. ``found`` gives for some fields what is found when the table is
    verified, by default what is there: that leaf and the manifest's siblings give folded_root.
    """
    found = found or {}
    own, now = leaf(*(F.col(c) for c in fields)), leaf(*(found.get(c, F.col(c)) for c in fields))
    changed = F.lit(False)
    for c, value in found.items():
        changed = changed | ~value.eqNullSafe(F.col(c))
    rows = docs.select(F.col(id_col).alias("id"), F.col(group).alias("grouped"), own.alias("digest"), F.when(changed, now).alias("now"))
    leaves = scratch.keep(placed(rows, "grouped", ["id", "digest"], scratch, "sorted").drop("grouped"), "leaves")
    scratch.drop("sorted")
    trees = levels(leaves, scratch, "tree")
    # subroots are the nodes of one more tree
    subroots = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(trees[-1].count()).alias("size"))
    over = levels(scratch.keep(subroots, "subroots"), scratch, "over")
    top = over[-1].first()
    root = top["digest"] if top else ""
    # the paths of subroots begin at the root, those of rows at their subroots
    tops = over[-1].select("tree", "pos", F.lit("").alias("subroot"), F.array().cast(PATH).alias("path"))
    tops = paths_down(tops, over, scratch, "over").join(over[0].select("pos", "digest"), "pos")
    tops = scratch.keep(tops.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "path"), "tops")
    tops = paths_down(tops, trees[1:], scratch, "tree")

    def made(table: pa.Table, block: dict, paths: list) -> pa.Table:
        kept, again = table["digest"].to_pylist(), table["now"].to_pylist()
        proofs = [digest("".join(a + b for a, b in p)) for p in paths]
        roots = [folded(n or d, p) for d, n, p in zip(kept, again, paths, strict=True)]
        told = {"subroot": [block["subroot"]] * len(kept), "root": [root] * len(kept), "proof_sha256": proofs, "folded_root": roots}
        return pa.table({"id": table["id"], "leaf": table["digest"]} | {c: pa.array(v, pa.string()) for c, v in told.items()} | {"verified": pa.array([r == root for r in roots])})

    kind = docs.schema[id_col].dataType.simpleString()
    out = traverse(leaves, tops, "id now", made, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)
