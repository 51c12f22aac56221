"""Names and paths of fields, types and files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(name: Column) -> Column:
    """Letters and digits only, in lower case. Dots go too, so a.bc and ab.c share a key."""
    return F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", ""))


def leaf(path: Column, strip_array: bool = True) -> Column:
    """What follows the last dot, without a trailing []."""
    last = F.substring_index(path, ".", -1)
    return F.regexp_replace(last, r"\[\]$", "") if strip_array else last


def bean_leaf(path: Column) -> Column:
    """norm(leaf) without a leading set, get or is. It is stripped after lower-casing, so issueDate gives suedate."""
    return F.regexp_replace(norm(leaf(path)), "^(set|get|is)", "")


def matches_selectors(target: Column, selectors: Column) -> Column:
    """Whether any selector names the target: equal, equal leaf, equal bean leaf, or either ends with the other."""
    t = norm(target)

    def one(s: Column) -> Column:
        n = norm(s)
        some = (F.length(n) > 0) & (F.length(t) > 0)
        return some & ((t == n) | (norm(leaf(target)) == norm(leaf(s))) | (bean_leaf(target) == bean_leaf(s)) | F.endswith(t, n) | F.endswith(n, t))

    return F.exists(selectors, one)


def parse_selectors(fields: list[str], csv: str | None = None) -> list[str]:
    """Selectors from repeated arguments and a comma-separated one, trimmed, empty ones dropped, first ones kept."""
    parts = [*fields, *(csv.split(",") if csv else [])]
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


def simple_type_name(fqcn: Column) -> Column:
    """What follows the last dot or dollar sign."""
    return F.regexp_extract(fqcn, r"([^.$]*)$", 1)


def package_path(fqcn: Column) -> Column:
    """Folders of the package: a.b.C gives a/b, and C gives nothing."""
    return F.when(F.instr(fqcn, ".") > 0, F.replace(F.regexp_replace(fqcn, r"\.[^.]*$", ""), F.lit("."), F.lit("/"))).otherwise("")


def outer_class(fqcn: Column) -> Column:
    """The class around a nested one: a.b.C$D gives C."""
    return F.substring_index(F.substring_index(fqcn, ".", -1), "$", 1)


def infer_worktree(path: Column, relative: Column) -> Column:
    """The folder in which ``relative`` gives ``path``; null if path doesn't end so."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.endswith(clean, F.concat(F.lit("/"), relative)), F.substring(clean, F.lit(1), F.length(clean) - F.length(relative) - 1))


#: Type names, in lower case, that have no fields of their own.
SCALARS = [
    "string", "int", "integer", "long", "double", "float", "boolean", "char", "byte", "short", "bigdecimal", "biginteger", "localdate",
    "localdatetime", "date", "instant", "uuid", "object",
]


def collection_element(type_name: Column) -> Column:
    """Element type of List, Set, Collection, ArrayList, LinkedList and arrays; null for other types."""
    t = F.trim(type_name)
    inner = F.regexp_extract(t, r"^(?:java\.util\.)?(?:List|Set|Collection|ArrayList|LinkedList)\s*<\s*([\w.$]+)\s*>$", 1)
    array = F.when(F.endswith(t, F.lit("[]")), F.trim(F.regexp_replace(t, r"\[\]$", "")))
    return F.coalesce(F.nullif(inner, F.lit("")), array)


def is_scalar_type(type_name: Column) -> Column:
    """Whether a type isn't to be expanded: none, one of the names in any case, alone or as an array, or any generic type."""
    t = F.trim(type_name)
    return F.coalesce(F.contains(t, F.lit("<")) | F.lower(F.regexp_replace(t, r"\[\]$", "")).isin(SCALARS), F.lit(True))


def decap(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 2**31 - 1))


def capital(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 2**31 - 1))


def accessor_field(method: Column) -> Column:
    """The field that setX, getX or isX stands for; null for other methods."""
    return decap(F.nullif(F.regexp_extract(method, r"^(?:set|get|is)([A-Z]\w*)$", 1), F.lit("")))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? do not, names with a dot in front match too."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(p) for p in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r"\.+^$()[]|" else glob[i]), i + 1
    return out


def in_scope(path: Column, globs: list[str]) -> Column:
    """Whether any glob of the scope matches the whole path."""
    return path.rlike("^(?:" + "|".join(map(glob_regex, globs)) + ")$") if globs else F.lit(False)


def pad(text: Column, width: int) -> Column:
    """Pad a report cell on the right; longer text is left as it is."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))
