"""Slices: a write site with its guards, the definitions that its expression uses, and the helpers that those call.

Sites, methods, classes and definitions are relations; only guards are found where the text is. Definitions and helpers are
closures by levels of equi-joins, so any number of files is sliced at once; what a bare call means in a class is a table of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import called_names, identifiers, qualified_calls
from weftline.sources.tables import Workspace, by_shuffle


def local_definitions(methods: DataFrame) -> DataFrame:
    """path, in_method, in_line, name and statement of the assignments in method bodies; a statement ends at its semicolon.

    Methods of one name are told apart by the line they begin on.
    """
    s = methods.select("path", F.col("name").alias("in_method"), F.col("start_line").alias("in_line"), F.explode(F.split(F.regexp_replace("body_text", r"^\s*\{|\}\s*$", ""), r"[;{}]")).alias("s"))
    s = s.select("path", "in_method", "in_line", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("statement"))
    name = F.regexp_extract("statement", r"^(?:(?:final\s+)?[\w.<>\[\], ?]+\s)?(\w+)\s*=(?!=)", 1)
    return s.withColumn("name", name).where("name <> ''").select("path", "in_method", "in_line", "name", F.concat("statement", F.lit(";")).alias("statement"))


def trace(sites: DataFrame, definitions: DataFrame, depth: int = 8) -> DataFrame:
    """site and statement: what defines, in steps, the names of each site's expression. Writes to the receiver are left out.

    sites: (site, path, in_method, in_line, receiver, expression).
    """
    work = Workspace(sites.sparkSession)
    owner = sites.select("site", "path", "in_method", "in_line", "receiver")
    front = work.keep_large(sites.select("site", F.explode(identifiers(F.col("expression"))).alias("name")).distinct())
    seen, found = front, None
    for _ in range(depth):
        step = front.join(owner, "site").join(definitions, ["path", "in_method", "in_line", "name"])
        step = work.keep_large(step.where(~F.contains("statement", F.concat("receiver", F.lit("."))) & (F.col("name") != F.col("receiver"))).select("site", "statement").distinct())
        found = step if found is None else found.unionByName(step).distinct()
        names = step.select("site", F.explode(identifiers(F.col("statement"))).alias("name")).distinct()
        front = work.keep_large(names.join(seen, ["site", "name"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return found


def homes(classes: DataFrame) -> DataFrame:
    """name, path and parent (simple name) of each class name: the class in a file of its name, else that of the first path."""
    named = F.endswith("path", F.concat(F.lit("/"), "name", F.lit(".java"))) | (F.col("path") == F.concat("name", F.lit(".java")))
    best = F.min(F.struct((~named).alias("away"), "path", "start_line", F.substring_index("parent", ".", -1).alias("parent"))).alias("b")
    return classes.groupBy("name").agg(best).select("name", "b.path", "b.parent")


def resolution(classes: DataFrame, methods: DataFrame, hops: int = 3) -> DataFrame:
    """path, class_name, helper, hop, body_text and full_text: what a bare call of each name means in each class.

    It is the class's own method, else that of the nearest of so many superclasses, wherever their files are; of overloads the first.
    Classes (path, name, parent, start_line); methods (path, class_name, name, start_line, body_text, full_text).
    """
    work = Workspace(classes.sparkSession)
    home = work.keep_large(homes(classes))
    own = classes.groupBy("path", "name").agg(F.min_by("parent", "start_line").alias("parent"))
    now = own.select("path", F.col("name").alias("class_name"), F.col("path").alias("at"), F.col("name").alias("of"), F.substring_index("parent", ".", -1).alias("parent"), F.lit(0).alias("hop"))
    chain = now = work.keep_large(now)
    above = home.select(F.col("name").alias("parent"), F.col("path").alias("up_at"), F.col("parent").alias("up"))
    for hop in range(1, hops + 1):
        now = work.keep_large(now.join(above, "parent").select("path", "class_name", F.col("up_at").alias("at"), F.col("parent").alias("of"), F.col("up").alias("parent"), F.lit(hop).alias("hop")))
        if now.isEmpty():
            break
        chain = chain.unionByName(now)
    # a class has few superclasses, so its methods are few; only places in the files are compared
    held = methods.select(F.col("path").alias("at"), F.col("class_name").alias("of"), F.col("name").alias("helper"), "start_line", "body_text", "full_text")
    met = chain.join(held, ["at", "of"])
    return met.groupBy("path", "class_name", "helper").agg(F.min_by(F.struct("hop", "body_text", "full_text"), F.struct("hop", "start_line")).alias("m")).select("path", "class_name", "helper", "m.*")


def helpers(texts: DataFrame, methods: DataFrame, classes: DataFrame, depth: int = 5) -> DataFrame:
    """site, helper, full_text and depth: methods that the texts (site, path, class_name, text) call, and those that they call.

    Bare calls mean what ``resolution`` finds for the text's class, also within helpers from elsewhere; Class.method calls are looked up in that
    class's file. A helper counts at its least depth.
    """
    work = Workspace(texts.sparkSession)
    own = work.keep_large(resolution(classes, methods)).select("path", "class_name", "helper", "body_text", "full_text")
    any_ = methods.join(homes(classes).select(F.col("name").alias("class_name"), "path"), ["class_name", "path"])
    any_ = any_.groupBy(F.concat_ws(".", "class_name", "name").alias("helper")).agg(F.min_by(F.struct("body_text", "full_text"), "start_line").alias("m")).select("helper", "m.*")
    front, found = texts.select("site", "path", "class_name", "text"), None
    for level in range(depth + 1):
        bare = front.select("site", "path", "class_name", F.explode(called_names(F.col("text"))).alias("helper")).distinct().join(own, ["path", "class_name", "helper"])
        far = front.select("site", "path", "class_name", F.explode(qualified_calls(F.col("text"))).alias("helper")).distinct().join(any_, "helper")
        new = bare.unionByName(far)
        if found is not None:
            new = new.join(by_shuffle(found.select("site", "helper")), ["site", "helper"], "left_anti")
        new = work.keep_large(new.withColumn("depth", F.lit(level)))
        found = new if found is None else found.unionByName(new)
        if new.isEmpty():
            break
        front = new.select("site", "path", "class_name", F.col("body_text").alias("text"))
    return found.select("site", "helper", "full_text", "depth")


def guards(files: DataFrame, target: str | None = None, language: str = "java") -> DataFrame:
    """path, target, line, target_field, statement and control_flow (lines) of every write site; files bring their target or share one."""
    from weftline.sources.java import scan

    if target is not None:
        files = files.withColumn("target", F.lit(target))
    return scan(files.select("path", "target", "text"), "guarded_sites", language=language).select("path", "target", "line", "target_field", "statement", "control_flow")


def slices(files: DataFrame, target: str | None = None, tree: DataFrame | None = None) -> DataFrame:
    """path, target, target_field, line, via, in_method, receiver, statement, helpers (array, nearest first), defs, control_flow and slice_text of every write site.

    Files (path, text) share one target or bring their own in a column. Helpers are looked up in ``tree`` (path, text), by default
    the files themselves, from the class around the site or, where files have a column class_name, from that class.
    """
    from weftline.sources.java import parse, scan

    if target is not None:
        files = files.withColumn("target", F.lit(target))
    sites = scan(files.select("path", "text", "target").distinct(), "guarded_sites")
    if "class_name" in files.columns:
        sites = sites.join(files.select("path", "target", "class_name").distinct(), ["path", "target"])
    parsed = parse(files.select("path", "text").distinct() if tree is None else tree.select("path", "text"), ["methods", "classes"])
    return slices_of(sites, Workspace(files.sparkSession).keep_large(parsed))


def slices_of(sites: DataFrame, parsed: DataFrame) -> DataFrame:
    """The slices of guarded sites, of what ``parse`` found as methods and classes in the tree; see ``slices``."""
    from weftline.sources.java import rows_of

    work = Workspace(sites.sparkSession)
    if "class_name" not in sites.columns:
        sites = sites.withColumn("class_name", F.col("in_class"))
    # a written number, so two equal writes on a line stay two
    sites = work.keep_large(sites.withColumn("site", F.monotonically_increasing_id()))
    methods = rows_of(parsed, "methods")
    defs = trace(sites, local_definitions(methods)).groupBy("site").agg(F.array_sort(F.collect_set("statement")).alias("defs"))
    sites = work.keep_large(sites.join(defs, "site", "left").withColumn("defs", F.coalesce("defs", F.array().cast("array<string>"))))
    text = F.concat_ws("\n", "expression", "defs", "control_flow")
    near = helpers(sites.select("site", "path", "class_name", text.alias("text")), methods, rows_of(parsed, "classes"))
    near = near.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("depth", "helper", "full_text"))).alias("h"))
    out = sites.join(near, "site", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<depth: int, helper: string, full_text: string>>")))
    flowed = F.when(F.size("defs") > 0, F.concat(F.array(F.lit("// local dataflow:")), F.col("defs")))
    told = F.transform("h", lambda h: F.concat(F.lit("\n// helper: "), h["helper"], F.lit("\n"), h["full_text"]))
    return out.select("path", "target", "target_field", "line", "via", "in_method", "receiver", "statement", F.transform("h", lambda h: h["helper"]).alias("helpers"), "defs", "control_flow", F.concat_ws("\n", heading(), "control_flow", flowed, "statement", told).alias("slice_text"))


def heading() -> Column:
    """The line that a slice begins with."""
    return F.format_string("// write site (line %d, in %s, via %s)", "line", "in_method", "via")
