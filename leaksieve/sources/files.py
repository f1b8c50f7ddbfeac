"""Contents of discovered files as string records, read in tasks by name: any file name, any size, one bad file stops no other.

Input is a table of files (source, root, file, relpath, size, ..), output is records (source, file, relpath, line, seq, keypath, path, value, note).
A record with a note is no string but an account of its file: what could not be read, and why.

Lines come from byte ranges, JSON documents from an event walk, databases from rowid ranges: no file is one row, and none has to fit in memory.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import shutil
import sqlite3
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import closing, contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.operators.staging import staged
from leaksieve.sources.tree import local_path
from leaksieve.sources.walk import leaves, walker

SPLIT = 32 << 20
ROWIDS = 50_000
_CHUNK = 1 << 20
_KEYS = ("source", "file", "relpath")
RECORD = (*_KEYS, "line", "seq", "keypath", "path", "value", "note")
_TYPES = pa.schema([(c, pa.string()) for c in _KEYS] + [("line", pa.int64()), ("seq", pa.int32()), ("keypath", pa.list_(pa.string())), ("path", pa.string()), ("value", pa.string()), ("note", pa.string())])
_SCHEMA = "source string, file string, relpath string, line long, seq int, keypath array<string>, path string, value string, note string"


@contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    here = local_path(path)
    if here is not None:
        with open(here, "rb") as f:
            yield f
    else:
        store, inner = arrow_fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as f:
            yield f


def _in_batches(rows: Iterator[dict], types: pa.Schema, most: int = 2_000, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r.get("value") or r.get("raw") or "")
        if len(held) >= most or size >= chars:
            yield from pa.Table.from_pylist(held, types).to_batches()
            held, size = [], 0
    yield from pa.Table.from_pylist(held, types).to_batches()


def _mapped(work: Callable[[dict], Iterator[dict]], types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _in_batches((r for row in batch.to_pylist() for r in work(row)), types)

    return run


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that stand for work, spread over as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lines_in(f: BinaryIO, start: int, end: int) -> Iterator[bytes]:
    r"""The lines (with their ends \n, \r\n or \r) that begin in [start, end)."""
    f.seek(max(start - 1, 0))
    held = b""  # bytes from `at` on that are not given out yet
    at = max(start - 1, 0)
    skipping = start > 0
    while True:
        chunk = f.read(_CHUNK)
        held += chunk
        pos = 0
        while True:
            if not skipping and at + pos >= end:
                return
            m = _BREAK.search(held, pos)
            if m is None or (m[0] == b"\r" and m.end() == len(held) and chunk):  # \n may follow
                break
            if skipping:
                skipping = False
            else:
                yield held[pos : m.end()]
            pos = m.end()
        held, at = held[pos:], at + pos
        if not chunk:
            if held and not skipping and at < end:
                yield held
            return


_BREAK = re.compile(rb"\r\n|\n|\r")
#: Characters that also break the lines of plain texts.
_WIDE = re.compile("[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_COUNT = pa.schema([(c, pa.string()) for c in _KEYS] + [("block", pa.int64()), ("n", pa.int64())])
_LINE = pa.schema([(c, pa.string()) for c in _KEYS] + [("line", pa.int64()), ("raw", pa.string()), ("note", pa.string())])


def _pieces(raw: bytes) -> list[str]:
    """A physical line of a plain text, cut where wide separators end lines as well."""
    text = raw.decode("utf-8", "replace")
    body = text.rstrip("\r\n")
    parts = _WIDE.split(body)
    if len(parts) > 1 and parts[-1] == "" and len(body) == len(text):  # the text ends with a wide separator
        parts.pop()
    return parts


def file_lines(files: DataFrame, wide: bool = False, split: int = SPLIT) -> DataFrame:
    """source, file, relpath, line (from 1), raw, note: physical lines with their ends, read in byte ranges.

    Files are read twice, to count the lines of each range and to give them their numbers: texts are neither written nor exchanged.
    wide: plain texts, whose lines also end at form feeds and the wide separators; raw then has no end.
    """
    ranges = files.select(*_KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("block"))

    def count(row: dict) -> Iterator[dict]:
        n = 0
        try:
            with opened(row["file"]) as f:
                for raw in lines_in(f, row["block"], row["block"] + split):
                    n += len(_pieces(raw)) if wide else 1
        except (OSError, pa.ArrowException):  # the second reading says so
            pass
        yield {c: row[c] for c in (*_KEYS, "block")} | {"n": n}

    def read(row: dict) -> Iterator[dict]:
        keys = {c: row[c] for c in _KEYS}
        line = row["before"]
        try:
            with opened(row["file"]) as f:
                for raw in lines_in(f, row["block"], row["block"] + split):
                    for text in _pieces(raw) if wide else (raw.decode("utf-8", "replace"),):
                        line += 1
                        yield keys | {"line": line, "raw": text, "note": None}
        except (OSError, pa.ArrowException) as e:
            yield keys | {"line": 0, "raw": None, "note": f"unreadable: {e}"[:300]}

    counts = staged(_dealt(ranges, "file", "block").mapInArrow(_mapped(count, _COUNT), "source string, file string, relpath string, block long, n long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*_KEYS).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    placed = counts.select(*_KEYS, "block", before.alias("before"))
    return _dealt(placed, "file", "block").mapInArrow(_mapped(read, _LINE), "source string, file string, relpath string, line long, raw string, note string")


def _account(lines: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return lines.where(F.col("note").isNotNull()).select(*_KEYS, F.lit(0).cast("long").alias("line"), F.lit(0).alias("seq"), empty.alias("keypath"), F.lit("[]").alias("path"), F.lit(None).cast("string").alias("value"), "note")


def jsonl_records(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """String leaves of each JSON line; a line that isn't JSON is an account."""
    lines = file_lines(files, split=split)
    body = lines.where(F.col("note").isNull() & (F.trim(F.regexp_replace("raw", r"[\r\n]+\z", "")) != ""))
    walked = body.withColumn("_w", walker()(F.regexp_replace("raw", r"[\r\n]+\z", "")))
    found = walked.select(*_KEYS, "line", "_w.failed", F.posexplode_outer("_w.strings").alias("seq", "_s"))
    strings = found.select(*_KEYS, "line", "seq", "_s.keypath", "_s.path", "_s.value", F.when(F.col("failed"), "a line that isn't JSON").alias("note"))
    kept = strings.where(F.col("value").isNotNull() | F.col("note").isNotNull()).withColumns({"seq": F.coalesce("seq", F.lit(0)), "keypath": F.coalesce("keypath", F.array().cast("array<string>")), "path": F.coalesce("path", F.lit("[]"))})
    return kept.unionByName(_account(lines))


def text_records(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Non-blank lines of plain texts; the key path is the line number."""
    lines = file_lines(files, wide=True, split=split)
    number = F.col("line").cast("string")
    rows = lines.where(F.col("note").isNull() & (F.trim("raw") != "")).select(*_KEYS, "line", F.lit(0).alias("seq"), F.array(number).alias("keypath"), F.concat(F.lit("["), number, F.lit("]")).alias("path"), F.col("raw").alias("value"), "note")
    return rows.unionByName(_account(lines))


_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:,]|[^\s"{}\[\]:,]+', re.DOTALL)
_SCALAR = re.compile(r"true|false|null|NaN|-?Infinity|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _tokens(f: BinaryIO, chunk: int) -> Iterator[str]:
    """Tokens of a JSON text that is read piece by piece; only a token that is not over yet is held."""
    decode = codecs.getincrementaldecoder("utf-8")("strict")
    held, first = "", True
    pieces: list[str] = []  # of a long string that has not ended
    while True:
        data = f.read(chunk)
        new = decode.decode(data, final=not data)
        if first and new:
            new, first = new.removeprefix("\ufeff"), False
        if pieces and data and '"' not in new:
            pieces.append(new)
            continue
        held = "".join([*pieces, held, new]) if pieces else held + new
        pieces = []
        end = 0
        for m in _TOKEN.finditer(held):
            if held[end : m.start()].strip(" \t\r\n"):
                break  # a string that has not ended, or something that is no token
            if m.end() == len(held) and data and m[0][0] not in '{}[]:,"':
                break  # a number may go on
            yield m[0]
            end = m.end()
        held = held[end:]
        if not data:
            if held.strip(" \t\r\n"):
                raise ValueError("the text ends within a token")
            return
        if held.startswith('"') and len(held) > chunk:
            pieces, held = [held], ""


def json_events(f: BinaryIO, chunk: int = _CHUNK) -> Iterator[tuple[tuple, str]]:
    """(key path, string) of every string value inside the objects and arrays of one JSON text, in bounded memory; ValueError where it isn't JSON.

    Strings before an error are given. Of a repeated key every value is given, as each of them is in the file.
    """
    path: list = []
    objects: list[bool] = []
    state = "value"  # value, first (value or an end), key, first key, colon, after
    for token in _tokens(f, chunk):
        kind = token[0]
        if state in ("key", "first key") and kind == '"':
            path[-1] = json.loads(token)
            state = "colon"
        elif state == "colon" and kind == ":":
            state = "value"
        elif state in ("value", "first") and kind == '"':
            value = json.loads(token)
            if path:
                yield tuple(path), value
            state = "after"
        elif state in ("value", "first") and kind in "{[":
            objects.append(kind == "{")
            path.append(None if kind == "{" else 0)
            state = "first key" if kind == "{" else "first"
        elif kind in "}]" and objects and objects[-1] == (kind == "}") and state in ("after", "first key" if kind == "}" else "first"):
            objects.pop()
            path.pop()
            state = "after"
        elif state == "after" and kind == "," and objects:
            state = "key" if objects[-1] else "value"
            if not objects[-1]:
                path[-1] += 1
        elif state in ("value", "first") and _SCALAR.fullmatch(token):
            state = "after"
        else:
            raise ValueError(f"unexpected {token[:20]!r}")
    if objects or state != "after":
        raise ValueError("the text ends early")


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _string(keys: dict, line: int, seq: int, path: Sequence, value: str) -> dict:
    return keys | {"line": line, "seq": seq, "keypath": [_clean(str(k)) for k in path], "path": json.dumps(list(path)), "value": _clean(value), "note": None}


def _noted(keys: dict, note: str) -> dict:
    return keys | {"line": 0, "seq": 0, "keypath": [], "path": "[]", "value": None, "note": note[:300]}


def json_records(files: DataFrame) -> DataFrame:
    """String leaves of whole-JSON files of any size."""

    def read(row: dict) -> Iterator[dict]:
        keys = {c: row[c] for c in _KEYS}
        try:
            with opened(row["file"]) as f:
                for seq, (path, value) in enumerate(json_events(f)):
                    yield _string(keys, 1, seq, path, value)
        except ValueError as e:
            yield _noted(keys, f"not JSON: {e}")
        except (OSError, pa.ArrowException) as e:
            yield _noted(keys, f"unreadable: {e}")

    return _dealt(files.select(*_KEYS), "file").mapInArrow(_mapped(read, _TYPES), _SCHEMA)


@contextmanager
def _database(path: str) -> Iterator[sqlite3.Connection]:
    """A read-only connection; a database in a store is copied to this task's scratch file for as long as it is open."""
    here, scratch = local_path(path), None
    if here is None:
        scratch = tempfile.NamedTemporaryFile(suffix=".db")  # noqa: SIM115
        with opened(path) as f:
            shutil.copyfileobj(f, scratch, _CHUNK)
        scratch.flush()
        here = scratch.name
    try:
        quoted = here.replace("%", "%25").replace("?", "%3f").replace("#", "%23")
        for how in ("mode=ro", "mode=ro&immutable=1"):  # the second where the folder can't hold a journal
            con = sqlite3.connect(f"file:{quoted}?{how}", uri=True)
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            try:
                con.execute("SELECT 1 FROM sqlite_master LIMIT 1")
                break
            except sqlite3.OperationalError:
                con.close()
                if "immutable" in how or not os.path.exists(here):
                    raise
        with closing(con):
            yield con
    finally:
        if scratch is not None:
            scratch.close()


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SchemaDrift(Exception):
    """A known table has none of the expected text columns."""


def table_ranges(con: sqlite3.Connection, columns: Mapping[str, Sequence[str]] | None, rowids: int) -> Iterator[dict]:
    """table, columns, low, high of the rowid ranges of the wanted tables (low None: a table without rowids, read whole); SchemaDrift as a note."""
    present = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\'")]
    for table in present if columns is None else [t for t in columns if t in present]:
        try:
            have = [r[1] for r in con.execute(f"PRAGMA table_info({_quote(table)})")]
            want = have if columns is None else [c for c in columns[table] if c in have]
            if not want:
                raise SchemaDrift(f"schema drift: table {table} has none of the columns {list(columns[table])}" if columns else f"table {table} has no columns")
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(table)}").fetchone()
            except sqlite3.OperationalError:
                yield {"table": table, "columns": want, "low": None, "high": None, "note": None}
                continue
            at = low
            while at is not None and at <= high:
                yield {"table": table, "columns": want, "low": at, "high": min(high, at + rowids - 1), "note": None}
                following = con.execute(f"SELECT min(rowid) FROM {_quote(table)} WHERE rowid > ?", (at + rowids - 1,)).fetchone()[0] if at + rowids - 1 < high else None
                at = following  # ids may have large gaps
        except (SchemaDrift, sqlite3.DatabaseError) as e:
            yield {"table": table, "columns": [], "low": None, "high": None, "note": str(e)}


def cell_strings(text: str, base: list, strict: bool) -> list[tuple[list, str]]:
    """(path, string) of a text cell: the leaves of JSON below its base path, else the text; a JSON scalar is text, or nothing with strict."""
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        return [(base, text)]
    if isinstance(doc, (dict, list)):
        return [(base + p, v) for p, v in leaves(doc)]
    return [] if strict else [(base, text)]


def sqlite_records(files: DataFrame, columns: Mapping[str, Sequence[str]] | None = None, strict: bool = False, rowids: int = ROWIDS) -> DataFrame:
    """Strings of SQLite files, read in rowid ranges of their tables; damaged files, drifted tables and failing ranges are accounts."""
    wanted = None if columns is None else {t: list(c) for t, c in columns.items()}
    types = pa.schema([(c, pa.string()) for c in _KEYS] + [("table", pa.string()), ("columns", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64()), ("note", pa.string())])

    def plan(row: dict) -> Iterator[dict]:
        keys = {c: row[c] for c in _KEYS}
        try:
            with _database(row["file"]) as con:
                yield from (keys | r for r in table_ranges(con, wanted, rowids))
        except (sqlite3.DatabaseError, OSError, pa.ArrowException) as e:
            yield keys | {"table": None, "columns": [], "low": None, "high": None, "note": f"not a readable database: {e}"[:300]}

    def read(row: dict) -> Iterator[dict]:
        keys = {c: row[c] for c in _KEYS}
        if row["note"] is not None:
            yield _noted(keys, row["note"])
            return
        try:
            with _database(row["file"]) as con:
                table = _quote(row["table"])
                for column in row["columns"]:
                    name = _quote(column)
                    if row["low"] is None:
                        cells = enumerate((v for (v,) in con.execute(f"SELECT CASE WHEN typeof({name}) = 'text' THEN {name} END FROM {table}")), 1)
                    else:
                        cells = con.execute(f"SELECT rowid, {name} FROM {table} WHERE rowid BETWEEN ? AND ? AND typeof({name}) = 'text'", (row["low"], row["high"]))
                    for rowid, text in cells:
                        for seq, (path, value) in enumerate(cell_strings(text, [row["table"], rowid, column], strict) if text else ()):
                            yield _string(keys, max(rowid, 1), seq, path, value)
        except (sqlite3.DatabaseError, OSError, pa.ArrowException) as e:
            yield _noted(keys, f"table {row['table']} from row {row['low']}: {e}")

    ranges = staged(_dealt(files.select(*_KEYS), "file").mapInArrow(_mapped(plan, types), "source string, file string, relpath string, `table` string, columns array<string>, low long, high long, note string"))
    return _dealt(ranges, "file", "table", "low").mapInArrow(_mapped(read, _TYPES), _SCHEMA)
