"""String leaves of JSON documents with their key paths, and of table columns."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from leaksieve.functions.slices import by_slices

_LEAF = pa.struct([("keypath", pa.list_(pa.string())), ("path", pa.string()), ("value", pa.string())])
_WALKED = pa.struct([("failed", pa.bool_()), ("strings", pa.list_(_LEAF))])


def leaves(doc, scalars: bool = False) -> Iterator[tuple[list, str]]:
    """(key path, string) of every string inside objects and arrays, in document order; keys and other scalars don't count.

    scalars: whether a document that is itself a string counts (with an empty path).
    """
    if isinstance(doc, str) and scalars:
        yield [], doc
    stack = [((), doc)]
    while stack:
        path, at = stack.pop()
        if isinstance(at, (dict, list)):
            items = list(at.items() if isinstance(at, dict) else enumerate(at))
            stack += [((*path, k), v) for k, v in reversed(items) if isinstance(v, (dict, list, str))]
        elif isinstance(at, str) and path:
            yield list(path), at


def walker(scalars: bool = False):
    """Arrow function: JSON text -> struct<failed, strings: array of (keypath, path, value)>.

    Python's parser decides: of repeated keys the last counts, NaN is accepted. path is the key path as a JSON array, which
    tells numbers from digits.
    """

    def some(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                found = [] if text is None else list(leaves(json.loads(text), scalars))
                clean = lambda s: s.encode("utf-8", "replace").decode()  # noqa: E731  lone surrogates
                out.append({"failed": False, "strings": [{"keypath": [clean(str(k)) for k in p], "path": json.dumps(p), "value": clean(v)} for p, v in found]})
            except (ValueError, RecursionError):
                out.append({"failed": True, "strings": []})
        return pa.array(out, _WALKED)

    @F.arrow_udf("struct<failed:boolean,strings:array<struct<keypath:array<string>,path:string,value:string>>>")
    def walk(texts: pa.Array) -> pa.Array:
        return by_slices(some, _WALKED, texts)

    return walk


def json_strings(rows: DataFrame, column: str, scalars: bool = False) -> DataFrame:
    """The other columns of rows with seq (from 0), keypath, path and value of each string leaf; null and bad documents have none."""
    keys = [c for c in rows.columns if c != column]
    walked = rows.withColumn("_w", walker(scalars)(F.col(column)))
    return walked.select(*keys, F.posexplode("_w.strings").alias("seq", "_s")).select(*keys, "seq", "_s.keypath", "_s.path", "_s.value")


def json_failed(column: str) -> Column:
    """Whether a non-blank text isn't JSON."""
    return (F.trim(F.col(column)) != "") & walker()(F.col(column))["failed"]


def string_columns(schema: StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of the string fields of a schema, nested structs included."""
    out: list[tuple[str, ...]] = []
    for f in schema.fields:
        if isinstance(f.dataType, StringType):
            out.append((*prefix, f.name))
        elif isinstance(f.dataType, StructType):
            out += string_columns(f.dataType, (*prefix, f.name))
    return out


def table_strings(table: DataFrame, keys: Sequence[str], source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every non-blank string cell of a table as a string record: source, file (key), relpath, line, seq, keypath, value.

    columns: dotted names of the string fields to take (default: all). Only those reach the scan.
    """
    paths = [p for p in string_columns(table.schema) if columns is None or ".".join(p) in columns]
    at = lambda p: F.col(".".join(f"`{x}`" for x in p))
    cells = F.array(*(F.struct(F.array(*map(F.lit, p)).alias("keypath"), at(p).alias("value")) for p in paths))
    key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    rows = table.select(F.lit(source).alias("source"), key.alias("file"), key.alias("relpath"), F.lit(1).cast("long").alias("line"), F.posexplode(cells).alias("seq", "_c"))
    return rows.select("source", "file", "relpath", "line", "seq", "_c.keypath", "_c.value").where(F.trim("value") != "")
