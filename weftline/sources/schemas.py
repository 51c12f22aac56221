"""Schema trees: import from samples and definitions, flattening, validation.

A node is a dict: name, type and, where they apply, itemType, required, description, children. Documents are small and are
parsed where they are; ``flat_schemas`` does it for a column of documents, in Arrow batches.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ["string", "integer", "number", "boolean", "date", "object", "array"]
METHODS = ["manual", "schema", "sample"]
FLAT = "path string, type string, required boolean, description string"


def primitive(value) -> str:
    """A number without a fraction is an integer, text that begins like a date is a date, null is a string."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "integer" if float(value).is_integer() else "number"
    return "date" if isinstance(value, str) and re.match(r"\d{4}-\d{2}-\d{2}", value, re.ASCII) else "string"


def from_value(name: str, value) -> dict:
    """Infer from a JSON value; an array is described by its first item."""
    if isinstance(value, dict):
        return {"name": name, "type": "object", "children": [from_value(k, v) for k, v in value.items()]}
    if not isinstance(value, list):
        return {"name": name, "type": primitive(value)}
    if value and isinstance(value[0], dict):
        return {"name": name, "type": "array", "itemType": "object", "children": from_value("", value[0])["children"]}
    return {"name": name, "type": "array", "itemType": primitive(value[0]) if value else "string"}


def from_sample(text: str, root: str = "root") -> dict:
    node = from_value(root, json.loads(text))
    return node if node["type"] == "object" and node["children"] else {"name": root, "type": "object", "children": [node]}


def from_property(name: str, spec: dict) -> dict:
    """A JSON Schema property. ``required`` is looked up in the property's own list, not its parent's."""
    kind = spec.get("type") if spec.get("type") in TYPES and spec.get("type") != "date" else "string"
    node = {"name": name, "type": kind}
    holder = spec
    if kind == "array":
        holder = spec.get("items") or {}
        item = holder.get("type")
        node["itemType"] = item if item in TYPES and item != "date" else "string"
    if node.get("itemType", kind) == "object":
        node["children"] = [from_property(k, v) for k, v in (holder.get("properties") or {}).items()]
    if isinstance(spec.get("description"), str):
        node["description"] = spec["description"]
    if isinstance(spec.get("required"), list) and name in spec["required"]:
        node["required"] = True
    return node


def from_json_schema(text: str, root: str = "root") -> dict:
    props = json.loads(text).get("properties") or {}
    return {"name": root, "type": "object", "children": [from_property(k, v) for k, v in props.items()]}


#: What a tag's or an attribute's name is made of.
NAME_CHARS = frozenset(string.ascii_letters + string.digits + "_:-")


def tags(text: str) -> Iterator[tuple[str, str, str]]:
    """(open, empty or close; name; what follows the name) of each tag of an XML or HTML text, in order.

    A tag goes from a < that a name follows to the next >, wherever it stands; text, declarations and instructions are passed over.
    """
    at = text.find("<")
    while at >= 0:
        begin = at + 1 + text.startswith("/", at + 1)
        end = begin
        while end < len(text) and text[end] in NAME_CHARS:
            end += 1
        stop = text.find(">", end)
        if end > begin and stop >= 0:
            body = text[end:stop]
            yield "close" if begin > at + 1 else "empty" if body.endswith("/") else "open", text[begin:end], body
            at = stop
        at = text.find("<", at + 1)


def attributes(body: str) -> list[tuple[str, str]]:
    """name="value" pairs in order; only values in double quotes count."""
    out = []
    quote = body.find('"')
    while quote >= 0:
        left = body[:quote].rstrip()
        name = left[:-1].rstrip() if left.endswith("=") else ""
        begin = len(name)
        while begin and name[begin - 1] in NAME_CHARS:
            begin -= 1
        stop = body.find('"', quote + 1)
        if begin < len(name) and stop >= 0:
            out.append((name[begin:], body[quote + 1 : stop]))
            body = body[stop + 1 :]
            quote = -1
        quote = body.find('"', quote + 1)
    return out


def xml_tree(text: str) -> dict:
    """The last outermost element with its attributes and children; text between tags is not kept, unclosed elements end where the text does."""
    root: dict = {"children": []}
    path = [root]
    for kind, name, body in tags(text):
        if kind == "close":
            del path[max(1, len(path) - 1) :]
            continue
        path[-1]["children"].append(el := {"tag": name, "attrs": attributes(body), "children": []})
        if kind == "open":
            path.append(el)
    if not root["children"]:
        raise ValueError("no XML element")
    return root["children"][-1]


def from_element(el: dict) -> dict:
    """An element with neither attributes nor children is a string; a repeated child is an array like its first."""
    children = [{"name": f"@{k}", "type": primitive(v)} for k, v in el["attrs"]]
    groups: dict[str, list] = {}
    for c in el["children"]:
        groups.setdefault(c["tag"], []).append(c)
    for tag, own in groups.items():
        node = from_element(own[0])
        if len(own) > 1:
            node = {"name": tag, "type": "array", "itemType": "object", "children": node["children"]} if node["type"] == "object" else {"name": tag, "type": "array", "itemType": node["type"]}
        children.append(node)
    return {"name": el["tag"], "type": "object", "children": children} if children else {"name": el["tag"], "type": "string"}


def from_xml(text: str, root: str = "root") -> dict:
    node = from_element(xml_tree(text.strip()))
    return {"name": root or node["name"], "type": "object", "children": node.get("children", []) if node["name"] == root else [node]}


#: XSD types; others are strings.
XSD_TYPES = {"integer": "integer", "decimal": "number", "double": "number", "boolean": "boolean", "date": "date"}


def from_xsd(text: str, root: str = "root", most: int = 50) -> dict:
    """The first elements of an XSD with the usual prefix as a flat object, however they nest; those without a name are called element."""
    named = (dict(attributes(body)) for kind, tag, body in tags(text) if tag == "xs:element" and kind != "close" and body.strip("/"))
    types = {f"xs:{k}": v for k, v in XSD_TYPES.items()}
    children = [{"name": a.get("name") or "element", "type": types.get(a.get("type", ""), "string")} for a in islice(named, most)]
    return {"name": root, "type": "object", "children": children}


def from_document(text: str) -> dict:
    """The source side of a schema document of version 1."""
    doc = json.loads(text)
    if doc.get("version") != 1 or not (doc.get("source") or {}).get("root"):
        raise ValueError("not a schema document of version 1")
    return doc["source"]["root"]


def import_schema(mode: str, text: str, root: str = "root") -> dict:
    """Import by mode; a JSON payload that looks like a JSON Schema is read as one."""
    if mode == "payload-json":
        data = json.loads(text)
        if data is None:
            raise ValueError("the payload is null")
        if isinstance(data, dict) and ("$schema" in data or ("type" in data and "properties" in data)):
            mode = "json-schema"
    readers = {"payload-json": from_sample, "json-schema": from_json_schema, "payload-xml": from_xml, "xsd": from_xsd}
    return from_document(text) if mode == "document" else readers[mode](text, root)


def walk(node: dict, parent: dict | None = None) -> Iterator[tuple[dict, dict | None]]:
    yield node, parent
    for c in node.get("children") or []:
        yield from walk(c, node)


def find(node: dict, path: str) -> dict | None:
    """The node at a dotted path of names below the root."""
    for name in path.split("."):
        node = next((c for c in node.get("children") or [] if c["name"] == name), None)
        if node is None:
            return None
    return node


def count(node: dict) -> int:
    """Nodes below the root."""
    return sum(1 for _ in walk(node)) - 1


def label(node: dict) -> str:
    item = node.get("itemType")
    return f"array<{item}>" if node["type"] == "array" and item and item != "object" else node["type"]


def flatten(node: dict, prefix: str = "", skip_root: bool = True) -> list[tuple[str, str, bool, str | None]]:
    """(path, type, required, description) of containers and leaves, each before its children; arrays have [] in the path."""
    out = []
    for n in node.get("children") or [] if skip_root else [node]:
        path = (f"{prefix}." if prefix else "") + n["name"] + ("[]" if n["type"] == "array" else "")
        out.append((path, label(n), bool(n.get("required")), n.get("description") or None))
        if n["type"] == "object" or n.get("itemType") == "object":
            out += flatten(n, path)
    return out


def known_fields(node: dict) -> str:
    return "\n".join(f"{p} ({t})" for p, t, _, _ in flatten(node))


def search_tree(node: dict, query: str) -> dict | None:
    """The tree of the nodes whose own name, or that of a node below, holds the query, in any case."""
    kept = [c for c in (search_tree(c, query) for c in node.get("children") or []) if c]
    return {**node, "children": kept} if kept or query.lower() in node["name"].lower() else None


def errors(doc: dict) -> list[str]:
    """What is wrong with a schema document, each with its place."""
    if not isinstance(doc, dict):
        return ["the document is no object"]
    out = [f"{k} is missing" for k in ("mapperId", "savedAt", "source", "target") if not doc.get(k)]
    out += ["version is not 1"] if doc.get("version") != 1 else []
    for side in ("source", "target"):
        s = doc.get(side) or {}
        if doc.get(side) and s.get("method") not in METHODS:
            out.append(f"{side}: method {s.get('method')}")
        if doc.get(side) and not s.get("root"):
            out.append(f"{side}: no root")

        def visit(n: dict, path: str) -> None:
            out.extend(f"{path}: {what}" for what, bad in (("no id", not n.get("id")), ("no name", not (n.get("name") or "").strip()), (f"type {n.get('type')}", n.get("type") not in TYPES), (f"itemType {n.get('itemType')}", n.get("type") == "array" and n.get("itemType") not in (None, *TYPES))) if bad)
            for c in n.get("children") or []:
                visit(c, f"{path}.{c.get('name')}")

        if s.get("root"):
            visit(s["root"], f"{side}.root")
    return out


def _checked(docs: DataFrame) -> DataFrame:
    """Documents (mapper_id, text) with their other columns as they are; one that isn't valid fails the job, with what is wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b["mapper_id"], b["text"], strict=True):
                if wrong := errors(json.loads(t.as_py())):
                    raise ValueError(f"{k}: {'; '.join(wrong)}")
            yield b

    return docs.mapInArrow(run, docs.schema)


#: Parts that a store of documents is kept in; a mapper is in one of them.
PARTS = 64


def _part(mapper_id: Column) -> Column:
    return F.pmod(F.xxhash64(mapper_id), F.lit(PARTS)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("mapper_id string, text string, saved long, part int").parquet(path)


def save_documents(docs: DataFrame, path: str) -> None:
    """Put schema documents (mapper_id, text) into a store; other mappers' stay, and an invalid one saves none.

    Every save adds files of its own, in a folder for each of at most ``PARTS`` parts, so their number doesn't grow with that of mappers. Its number
    is one above the last one's, so one save at a time.
    """
    try:
        last = _stored(docs.sparkSession, path).agg(F.max("saved")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = 0
    each = docs.select("mapper_id", "text", F.lit(last + 1).cast("long").alias("saved"), _part(F.col("mapper_id")).alias("part"))
    _checked(each.repartition(PARTS, "part")).write.mode("append").partitionBy("saved", "part").parquet(path)


def load_documents(spark: SparkSession, path: str, mapper_id: str | None = None) -> DataFrame:
    """Each mapper's documents (mapper_id, text) of its last save, validated again; of one mapper only its part is read."""
    docs = _stored(spark, path)
    if mapper_id is not None:
        docs = docs.where((F.col("part") == _part(F.lit(mapper_id))) & (F.col("mapper_id") == mapper_id))
    newest = F.rank().over(Window.partitionBy("part", "mapper_id").orderBy(F.desc("saved")))
    return _checked(docs.withColumn("_n", newest).where("_n = 1").select("mapper_id", "text"))


def has_content(side: dict) -> bool:
    return bool(side["root"].get("children"))


_SPARK = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.StringType()}


def spark_type(node: dict) -> T.DataType:
    """The engine's type of a node; dates stay text."""
    if node["type"] == "object" or node["type"] == "array" and node.get("itemType") == "object":
        inner = T.StructType([T.StructField(c["name"], spark_type(c), not c.get("required"), {"comment": c["description"]} if c.get("description") else None) for c in node.get("children") or []])
        return T.ArrayType(inner) if node["type"] == "array" else inner
    return T.ArrayType(_SPARK.get(node.get("itemType", "string"), T.StringType())) if node["type"] == "array" else _SPARK[node["type"]]


def flat_type(kind: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of a struct type's leaves and containers, in order."""
    out = []
    for f in kind.fields:
        many = isinstance(f.dataType, T.ArrayType)
        inner = f.dataType.elementType if many else f.dataType
        path = (f"{prefix}." if prefix else "") + f.name + ("[]" if many else "")
        out.append((path, f.dataType.simpleString() if not isinstance(inner, T.StructType) else "array" if many else "object"))
        if isinstance(inner, T.StructType):
            out += flat_type(inner, path)
    return out


#: Rows that leave a task together.
ROWS_AT_ONCE = 5000
_FLAT_ARROW = {"pos": pa.int32(), "path": pa.string(), "type": pa.string(), "required": pa.bool_(), "description": pa.string()}


def flat_schemas(docs: DataFrame, key: str, text: str, mode: str) -> DataFrame:
    """key and the flattened fields of every document of a column; documents that can't be read give none.

    A task holds one document's tree and some thousand rows, however many a batch gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for n in range(b.num_rows):
                try:
                    new = flatten(import_schema(mode, b[text][n].as_py()))
                except (ValueError, TypeError, AttributeError):
                    new = []
                at += [n] * len(new)
                rows += [(i, *f) for i, f in enumerate(new)]
                if rows and (len(rows) >= ROWS_AT_ONCE or n + 1 == b.num_rows):
                    found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FLAT_ARROW.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b[key].take(pa.array(at)), *found], names=[key, *_FLAT_ARROW])
                    at, rows = [], []

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, pos int, {FLAT}")
