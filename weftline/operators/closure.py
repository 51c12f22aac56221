"""Closures over call, inheritance, def-use and nesting graphs: bounded levels of joins.

A level's rows are kept as a table, so no level computes the ones before again. Every level is one equi-join with the edges and drops what was reached before, so the number of rows is that of distinct
(start, node) pairs. Reached sets are by least depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import Workspace


def reach(starts: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """start, node and the least depth at which edges (caller, callee) lead to it, from starts (start, node)."""
    work = Workspace(starts.sparkSession)
    found = front = work.keep(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)))
    hops = work.keep(edges.select("caller", "callee").distinct())
    for level in range(1, depth + 1):
        step = front.join(hops, F.col("node") == F.col("caller")).select("start", F.col("callee").alias("node")).distinct()
        front = work.keep(step.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def superclasses(classes: DataFrame, hops: int = 3) -> DataFrame:
    """Classes (name, parent) with up to three ancestors, nearest first."""
    chain = classes.select("name", F.array("parent").alias("up"), F.col("parent").alias("top"))
    nodes = classes.select(F.col("name").alias("_n"), F.col("parent").alias("_p"))
    for _ in range(hops - 1):
        chain = chain.join(nodes, F.col("top") == F.col("_n"), "left").select("name", F.concat("up", F.array("_p")).alias("up"), F.col("_p").alias("top"))
    return chain.select("name", F.array_compact("up").alias("ancestors"))


def nested_leaves(fields: DataFrame, root: str | DataFrame, depth: int = 6) -> tuple[DataFrame, ...]:
    """Leaf paths of a type over fields (class_name, name, type): (path, type), and diagnostics (path, reason).

    Collections give a[].b. A type within itself, an unknown type and one too deep are not expanded but told. ``root`` may be a
    table (mapper_id, class_name) of roots, all of which are walked at once; then every row has its mapper_id, and a third table
    has the expanded types themselves: (mapper_id, path, type_name). Where fields have a pos, ``order`` tells a path's place.
    """
    from weftline.functions.names import collection_element, is_scalar_type, simple_type_name

    spark = fields.sparkSession
    work = Workspace(spark)
    single = isinstance(root, str)
    roots = spark.createDataFrame([("", root)], "mapper_id string, class_name string") if single else root
    pos = F.col("pos") if "pos" in fields.columns else F.lit(0)
    declared = fields.select("class_name", "name", "type", pos.cast("int").alias("pos"))
    known = declared.select(F.col("class_name").alias("_known")).distinct()
    now = roots.select("mapper_id", "class_name").join(declared, "class_name").select("mapper_id", F.col("name").alias("path"), "type", F.array("class_name").alias("above"), F.array("pos").alias("order"))
    done: DataFrame | None = None
    told: DataFrame | None = None
    nested: DataFrame | None = None
    for level in range(depth + 1):
        element = collection_element(F.col("type"))
        element = F.when(~is_scalar_type(element), element) if level < depth else F.lit(None).cast("string")
        now = now.withColumn("element", element).withColumn("inner", simple_type_name(F.regexp_replace(F.coalesce("element", F.trim("type")), r"\[\]$", "")))
        marked = work.keep(now.join(known, F.col("inner") == F.col("_known"), "left"))
        if level and marked.isEmpty():
            break
        loops, deep = F.array_contains("above", F.col("inner")), F.lit(level == depth)
        leaf = F.col("element").isNull() & is_scalar_type(F.col("type"))
        reason = F.when(leaf, None).when(deep, "too deep").when(loops, "cycle").when(F.col("_known").isNull(), "type not found")
        open_ = ~leaf & F.col("_known").isNotNull() & ~loops & ~deep
        rest = marked.where(~open_)
        leaves, said = rest.select("mapper_id", "path", "type", "order"), rest.select("mapper_id", "path", reason.alias("reason")).where("reason is not null")
        inside = marked.where(open_).withColumn("path", F.concat("path", F.when(F.col("element").isNotNull(), "[]").otherwise("")))
        types = inside.select("mapper_id", "path", F.col("inner").alias("type_name"), "order")
        done = leaves if done is None else done.unionByName(leaves)
        told = said if told is None else told.unionByName(said)
        nested = types if nested is None else nested.unionByName(types)
        if level < depth:
            kids = declared.select(F.col("class_name").alias("_c"), F.col("name").alias("_name"), F.col("type").alias("_type"), F.col("pos").alias("_pos"))
            now = inside.join(kids, F.col("inner") == F.col("_c")).select("mapper_id", F.concat_ws(".", "path", "_name").alias("path"), F.col("_type").alias("type"), F.concat("above", F.array("inner")).alias("above"), F.concat("order", F.array("_pos")).alias("order"))
    return (done.select("path", "type"), told.select("path", "reason")) if single else (done, told, nested)
