"""What source text shows without a parser, as column expressions: scrubbed text, lines, and calls and assignments with the lines they stand on.

Where a pattern matches is told by a mark that replaces nothing: it is put before each match, and the lines that have marks are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What looks like a write, and what it is called in diagnostics.
LOOSE = [
    (r"\.\s*set[A-Z]\w*\s*\(", "setter-like call"),
    (r"\.\s*with[A-Z]\w*\s*\(", "fluent with* call"),
    (r"::\s*set[A-Z]\w*\b", "method-reference setter"),
]
#: Comments, literals, runs of other characters, and single ones.
_TOKENS = r"""(?s)//[^\n]*+|/\*.*?(?:\*/|\z)|"[^"\\]*+(?:\\.[^"\\]*+)*+\\?(?:"|\z)|'[^'\\]*+(?:\\.[^'\\]*+)*+\\?(?:'|\z)|[^/"']++|."""
#: Marks; they are taken out of the text before.
_HIT, _NEXT = "\x01", "\x02"


def scrub(text: Column) -> Column:
    """The text with comments and literals as spaces; every other character and line stays where it is."""
    hidden = lambda t: F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*")) | F.startswith(t, F.lit('"')) | F.startswith(t, F.lit("'"))
    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(hidden(t), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")


def marked_lines(text: Column, pattern: str, groups: int) -> Column:
    """The text's lines with a mark and the pattern's groups before each match, on the line where it begins."""
    mark = _HIT + "".join(f"${g}{_NEXT}" for g in range(1, groups + 1)) + _HIT
    return F.split(F.regexp_replace(F.translate(text, _HIT + _NEXT, "  "), f"(?U){pattern}", f"{mark}$0"), "\n", -1)


def matches(files: DataFrame, own: list[str], text: Column, pattern: str, names: list[str]) -> DataFrame:
    """own, line and a column for each group of the pattern, of every match; a group without a match is empty."""
    shown = files.select(*own, F.posexplode(marked_lines(text, pattern, len(names))).alias("line", "t"))
    hits = F.regexp_extract_all("t", F.lit(f"{_HIT}([^{_HIT}]*){_HIT}"), F.lit(1))
    each = shown.select(*own, (F.col("line") + 1).cast("int").alias("line"), F.explode(hits).alias("h"))
    return each.select(*own, "line", *[F.get(F.split("h", _NEXT, -1), F.lit(k)).alias(n) for k, n in enumerate(names)])


def lines(files: DataFrame, own: list[str]) -> DataFrame:
    """own, line, text and bare of every line: as it is, and without comments and literals."""
    text = F.coalesce("text", F.lit(""))
    zipped = F.arrays_zip(F.split(text, "\n", -1).alias("text"), F.split(scrub(text), "\n", -1).alias("bare"))
    return files.select(*own, F.posexplode(zipped).alias("line", "l")).select(*own, (F.col("line") + 1).cast("int").alias("line"), F.col("l.text").alias("text"), F.col("l.bare").alias("bare"))


def loose_writes(files: DataFrame, own: list[str]) -> DataFrame:
    """own, line, hint and evidence (the line) of anything that looks like a write, once a line. A put is never found, since its quote is blanked."""
    text = F.coalesce("text", F.lit(""))
    plain = F.split(text, "\n", -1)
    each = files.select(*own, plain.alias("plain"), scrub(text).alias("bare"))
    found = []
    for pattern, hint in LOOSE:
        on = F.filter(F.transform(marked_lines(F.col("bare"), pattern, 0), lambda t, k: F.when(F.contains(t, F.lit(_HIT)), k)), lambda k: k.isNotNull())
        named = F.lit(hint).alias("hint")
        found.append(F.transform(on, lambda k: F.struct(k.alias("k"), named)))  # noqa: B023
    hits = each.select(*own, "plain", F.explode(F.array_sort(F.concat(*found))).alias("h"))
    line = F.get("plain", F.col("h.k"))
    return hits.select(*own, (F.col("h.k") + 1).cast("int").alias("line"), "h.hint", F.substring(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), 1, 120).alias("evidence"))


def injections(files: DataFrame, own: list[str]) -> DataFrame:
    """own, method, name, is_call and line: what is handed to a call as its only or first name, and whether the name is called itself."""
    found = matches(files, own, F.coalesce("text", F.lit("")), r"\.(\w+)\s*\(\s*(\w+)\s*(\()?", ["method", "name", "opens"])
    return found.select(*own, "method", "name", (F.col("opens") != "").alias("is_call"), "line")


def assignments(files: DataFrame, own: list[str]) -> DataFrame:
    """own, name and line: the lines on which a name is assigned, each once."""
    found = matches(files.withColumn("_row", F.monotonically_increasing_id()), [*own, "_row"], F.coalesce("text", F.lit("")), r"\b(\w+)\s*=(?!=)", ["name"])
    return found.distinct().select(*own, "name", "line")


#: Kinds of rows that expressions find, by name.
KINDS = {"lines": lines, "loose_writes": loose_writes, "injections": injections, "assignments": assignments}
