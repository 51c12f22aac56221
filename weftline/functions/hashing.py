"""Content hashes and the identifiers made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\n---\n"
#: Fixed value: version of the pipeline fingerprint.
PIPELINE_VERSION = "9"


def store_fingerprint(schema: Column, source: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, schema, source), 256)


def pipeline_fingerprint(model: Column, schema: Column, source: Column, version: str = PIPELINE_VERSION) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(version), model, schema, source), 256)


def source_sha(source: Column) -> Column:
    return F.substring(F.sha2(source, 256), 1, 12)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 40)


def field_key(field: Column) -> Column:
    return F.substring(F.sha2(field, 256), 1, 32)


def blob_key(path: Column, blob: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, blob), 256)


def defect_id(*parts: Column) -> Column:
    """KOD- and 1000 + the first six hex digits of the parts' hash modulo 9000."""
    six = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 6), 16, 10).cast("long")
    return F.concat(F.lit("KOD-"), (1000 + six % 9000).cast("string"))
