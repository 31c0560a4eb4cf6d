"""From the bytes of a source file to its observations."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.functions.schemas import OBSERVATION
from skeingraph.runtime import map_columns
from skeingraph.sources.languages import language_of, module_of


def observe(path: str, content: bytes, repo_id: str) -> list[dict]:
    """Observations of one file in order; none for an unknown language. Never raises: what a parser
    can't read becomes a parse_error after the file's and the module's rows."""
    language = language_of(path)
    if language is None:
        return []
    if language == "python":
        from skeingraph.sources.extract.python import extract
    else:
        from skeingraph.sources.extract.walkers import extract
    return extract(path, content, repo_id, language, module_of(path, language))


def parsed(rows: DataFrame, repo_id: str) -> DataFrame:
    """Rows with content instead with content_hash and found, their observations as JSON: both of the
    same bytes."""
    kept = [c for c in rows.columns if c != "content"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("content_hash", T.StringType()), T.StructField("found", T.StringType())])

    def run(*columns):
        given = dict(zip([*kept, "content"], columns, strict=True))
        hashes = [hashlib.sha256(c or b"").hexdigest() for c in given["content"]]
        return *(given[c] for c in kept), hashes, [json.dumps([{"ord": i, **o} for i, o in enumerate(observe(p, c or b"", repo_id))]) for p, c in zip(given["file_path"], given["content"], strict=True)]

    return map_columns(rows.select(*kept, "content"), schema, lambda: run, rows=16)


def unpacked(found: DataFrame) -> DataFrame:
    """The observations of rows from parsed(), in the schema of functions.schemas."""
    return found.select(F.explode(F.from_json("found", T.ArrayType(T.StructType.fromDDL(OBSERVATION)))).alias("o")).select("o.*")


def observations(rows: DataFrame, repo_id: str) -> DataFrame:
    """Observations of rows (file_path, content)."""
    return unpacked(parsed(rows.select("file_path", "content"), repo_id))
