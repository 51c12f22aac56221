"""The mapper registry, a small YAML document, and its checks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.names import glob_regex, outer_class, package_path
from weftline.sources.files import tree

FIELDS = ["id", "sourceFile", "class", "entryMethod", "sourceType", "targetType", "goldenTests"]
COLUMNS = ["id", "source_file", "class", "entry_method", "source_type", "target_type", "golden_tests"]
#: Where a package's folders can begin.
SOURCE_ROOTS = ["src/main/java", "src", "app/src/main/java", "main/java", ""]


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    return {"": None, "null": None, "~": None, "true": True, "false": False}.get(text, text)


def parse_yaml(text: str):
    """Nested maps, lists and scalars by indentation: the part of YAML that registries use."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int):
        if i < len(lines) and lines[i][0] >= indent and lines[i][1].startswith("- "):
            out, at = [], lines[i][0]
            while i < len(lines) and lines[i][0] == at and lines[i][1].startswith("- "):
                rest = lines[i][1][2:].strip()
                if ":" in rest and rest[0] not in "\"'" and (rest.endswith(":") or ": " in rest):
                    lines[i] = (at + 2, rest)
                    value, i = block(i, at + 2)
                else:
                    value, i = _scalar(rest), i + 1
                out.append(value)
            return out, i
        out, at = {}, lines[i][0] if i < len(lines) else 0
        while i < len(lines) and lines[i][0] == at and not lines[i][1].startswith("- "):
            key, _, rest = lines[i][1].partition(":")
            i += 1
            if rest.strip():
                out[key.strip()] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > at or lines[i][0] == at and lines[i][1].startswith("- ")):
                out[key.strip()], i = block(i, lines[i][0])
            else:
                out[key.strip()] = None
        return out, i

    return block(0, 0)[0] if lines else {}


def load(path: str) -> dict:
    """A registry; repo, branch and a scope that isn't empty are required."""
    found = parse_yaml(Path(path).read_text())
    for key in ("repo", "branch", "scope"):
        if not found.get(key):
            raise ValueError(f"the registry has no {key}")
    found["mappers"] = found.get("mappers") or []
    return found


def parse_slug(slug: str) -> tuple[str, str]:
    """Owner and name of owner/name."""
    parts = slug.split("/")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"not owner/name: {slug}")
    return parts[0], parts[1]


def mappers(spark: SparkSession, registry: dict) -> DataFrame:
    rows = [tuple(m.get(k) for k in FIELDS) for m in registry["mappers"]]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in COLUMNS))


def assert_in_scope(path: str, globs: list[str]) -> None:
    import re

    if not any(re.fullmatch(glob_regex(g), path) for g in globs):
        raise ValueError(f"{path} is outside the scope")


def type_candidates(types: DataFrame, type_col: str) -> DataFrame:
    """Paths at which a type's file is looked for, in order of priority."""
    roots = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(r).alias("root")) for i, r in enumerate(SOURCE_ROOTS)])
    at = types.withColumn("r", F.explode(roots))
    parts = F.array_compact(F.array(F.nullif("r.root", F.lit("")), F.nullif(package_path(F.col(type_col)), F.lit("")), F.concat(outer_class(F.col(type_col)), F.lit(".java"))))
    return at.select(*types.columns, F.col("r.rank").alias("rank"), F.array_join(parts, "/").alias("path"))


def find_types(types: DataFrame, type_col: str, files: DataFrame) -> DataFrame:
    """Types with the path of their file (null if there is none): by package below a source root, else by base name, shortest path first."""
    exact = type_candidates(types.select(type_col).distinct(), type_col).join(files.select("path"), "path").groupBy(type_col).agg(F.min_by("path", "rank").alias("exact"))
    base = files.select("path", F.substring_index("path", "/", -1).alias("base")).groupBy("base").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("loose"))
    out = types.join(exact, type_col, "left").withColumn("base", F.concat(outer_class(F.col(type_col)), F.lit(".java"))).join(base, "base", "left")
    return out.withColumn("type_path", F.coalesce("exact", "loose")).drop("exact", "loose", "base")


def check_worktree(mappers: DataFrame, worktree: str | None) -> DataFrame:
    """The check against the files below a worktree; one that doesn't exist is an issue of its own, and then only entries are checked."""
    spark = mappers.sparkSession
    if worktree:
        p = spark._jvm.org.apache.hadoop.fs.Path(worktree)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return check(mappers, tree(spark, worktree, ".java").select("path"))
        lost = spark.createDataFrame([("*", "error", "worktree-missing")], "mapper_id string, severity string, code string")
        return check(mappers, None).unionByName(lost)
    return check(mappers, None)


def check(mappers: DataFrame, files: DataFrame | None) -> DataFrame:
    """mapper_id, severity and code of every issue; without files only the entries themselves are checked."""

    def issue(test, severity: str, code: str):
        return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    own = [issue(blank("source_file"), "error", "missing-sourceFile"), issue(blank("class"), "error", "missing-class"), issue(blank("target_type"), "error", "missing-targetType")]
    own += [issue(blank("source_type"), "warn", "missing-sourceType"), issue(blank("entry_method"), "warn", "missing-entryMethod")]
    if files is None:
        own.append(issue(~blank("source_file"), "warn", "no-worktree"))
        return mappers.select(F.col("id").alias("mapper_id"), F.explode(F.array_compact(F.array(*own))).alias("i")).select("mapper_id", "i.*")
    there = files.select(F.col("path").alias("source_file")).distinct().withColumn("there", F.lit(True))
    out = mappers.join(there, "source_file", "left")
    for side in ("target_type", "source_type"):
        found = find_types(mappers.select(side).where(~blank(side)).distinct(), side, files).select(side, F.col("type_path").alias(f"{side}_path"))
        out = out.join(found, side, "left")
    own.append(issue(~blank("source_file") & F.col("there").isNull(), "error", "sourceFile-missing"))
    own.append(issue(~blank("target_type") & F.col("target_type_path").isNull(), "error", "targetType-unresolved"))
    own.append(issue(~blank("source_type") & F.col("source_type_path").isNull(), "warn", "sourceType-unresolved"))
    return out.select(F.col("id").alias("mapper_id"), F.explode(F.array_compact(F.array(*own))).alias("i")).select("mapper_id", "i.*")


def passes(issues: DataFrame) -> bool:
    return issues.where("severity = 'error'").isEmpty()
