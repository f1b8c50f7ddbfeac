"""Discovery of history files as a table: folders are listed in tasks, level by level.

A frontier of folders is dealt over the cluster; a task walks down from each of its folders and hands back those it has not come to,
which the next round deals anew, so no subtree is one task's work and no path passes through the driver. Names that begin with a
dot count like any other. What discovery leaves out is part of the table: folders cut by a depth, pruned by name, links that
leave their root, and folders that can't be read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.operators.staging import staged

#: Folders that a task lists before it hands the rest back.
FOLDERS = 2_000


class Wanted(NamedTuple):
    """What to look for below the roots of a source: globs by index, names never entered (skip: anywhere, skip_top: in a root that is a home), and limits."""

    globs: tuple[tuple[int, str, str], ...]  # index, glob, excluded file name
    skip: tuple[str, ...] = ()
    skip_top: tuple[str, ...] = ()
    depth: int | None = None
    contained: str | None = None  # links must stay below this folder of the root


def path_pattern(glob: str) -> str:
    """A path glob as a pattern: ** crosses folders, * doesn't, {a,b} are alternatives, [!x] excludes."""
    out = ""
    for part in re.split(r"(\*\*/|\*|\[!?[^\]]*\]|[{},])", glob):
        known = {"**/": "(?:.*/)?", "*": "[^/]*", "{": "(?:", "}": ")", ",": "|"}
        out += known.get(part) or (part.replace("[!", "[^") if part.startswith("[") else re.escape(part))
    return out


@lru_cache(maxsize=1024)
def _compiled(glob: str) -> re.Pattern:
    return re.compile(path_pattern(glob))


def may_hold(folder: str, glob: str) -> bool:
    """Whether files that match the glob can lie in or below a folder (a relative path)."""
    steps = glob.split("/")[:-1]
    for at, name in enumerate(folder.split("/") if folder else []):
        if at >= len(steps):
            return False
        if steps[at] == "**":
            return True
        if not _compiled(steps[at]).fullmatch(name):
            return False
    return True


def local_path(path: str) -> str | None:
    """The path of a file that any process of this machine opens by name; None for a store with a scheme of its own."""
    if path.startswith("file:"):
        return re.sub(r"^file:/+", "/", path)
    return path if "://" not in path else None


def _entries(folder: str) -> list[tuple[str, str, int | None, datetime | None]]:
    """(name, dir | file | link, size, modified) of a folder's entries; a link has the size of its target."""
    here = local_path(folder)
    if here is None:
        store, inner = arrow_fs.FileSystem.from_uri(folder)
        kinds = {arrow_fs.FileType.Directory: "dir", arrow_fs.FileType.File: "file"}
        return [(e.base_name, kinds[e.type], e.size, e.mtime) for e in store.get_file_info(arrow_fs.FileSelector(inner)) if e.type in kinds]
    out = []
    with os.scandir(here) as found:
        for e in found:
            try:
                kind = "link" if e.is_symlink() else "dir" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else None
                if kind == "link" and not e.is_file():
                    kind = "dirlink" if e.is_dir() else None
                stat = e.stat() if kind in ("file", "link") else None
            except OSError:
                continue
            if kind:
                out.append((e.name, kind, stat and stat.st_size, stat and datetime.fromtimestamp(stat.st_mtime, timezone.utc)))
    return sorted(out, key=lambda e: e[0])


_ROW = pa.schema([("source", pa.string()), ("root", pa.string()), ("home", pa.bool_()), ("relpath", pa.string()), ("depth", pa.int32()), ("binding", pa.int32()), ("file", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("state", pa.string()), ("note", pa.string())])
SCHEMA = "source string, root string, home boolean, relpath string, depth int, binding int, file string, size long, modified timestamp, state string, note string"


def _inside(path: str, top: str) -> bool:
    real, above = os.path.realpath(path), os.path.realpath(top)
    return real == above or real.startswith(above.rstrip("/") + "/")


def walk(row: dict, wanted: Wanted, folders: int = FOLDERS) -> Iterator[dict]:
    """Rows of the files and left-out folders below one frontier folder; state open: a folder that is still to be walked."""
    root = row["root"].rstrip("/")
    base = {k: row[k] for k in ("source", "root", "home")} | {"binding": None, "size": None, "modified": None, "note": None}
    at = lambda rel, depth, state, **more: base | {"relpath": rel, "depth": depth, "state": state, "file": f"{root}/{rel}" if rel else root} | more
    stack, listed = [(row["relpath"], row["depth"])], 0
    while stack:
        rel, depth = stack.pop()
        if listed >= folders:
            yield at(rel, depth, "open")
            continue
        listed += 1
        try:
            entries = _entries(f"{root}/{rel}" if rel else root)
        except FileNotFoundError:
            if rel:
                yield at(rel, depth, "unreadable", note="it is gone")
            continue  # an absent root holds no history
        except (OSError, pa.ArrowException) as e:
            yield at(rel, depth, "unreadable", note=str(e)[:200])
            continue
        inner = []
        for name, kind, size, modified in entries:
            path = f"{rel}/{name}" if rel else name
            if kind == "dir":
                if name in wanted.skip or (row["home"] and not rel and name in wanted.skip_top):
                    yield at(path, depth + 1, "pruned")
                elif any(may_hold(path, glob) for _, glob, _ in wanted.globs):
                    inner.append(path)
            elif kind == "dirlink":
                if any(may_hold(path, glob) for _, glob, _ in wanted.globs):
                    yield at(path, depth + 1, "link", note="a link to a folder isn't followed")
            else:
                for index, glob, exclude in wanted.globs:
                    if name != exclude and _compiled(glob).fullmatch(path):
                        outside = kind == "link" and wanted.contained is not None and not _inside(f"{root}/{path}".removeprefix("file://"), f"{root}/{wanted.contained}".removeprefix("file://"))
                        yield at(path, depth + 1, "escape" if outside else "file", binding=index, size=size, modified=modified)
        if wanted.depth is not None and depth >= wanted.depth:
            if inner:
                yield at(rel, depth, "cut", note=f"{len(inner)} folders lie deeper than {wanted.depth}")
        else:
            stack += [(path, depth + 1) for path in reversed(inner)]


def discover(spark: SparkSession, wanted: Mapping[str, Wanted], roots: Mapping[str, str | Sequence[str]], homes: Sequence[str] = (), folders: int = FOLDERS) -> DataFrame:
    """SCHEMA: files (state file) and what was left out (cut, pruned, link, escape, unreadable) below the roots of each source.

    homes: the roots that are home folders. The walk is written round by round, and read back.
    """
    start = [(s, r, r in homes, "", 0) for s in wanted for r in ([roots[s]] if isinstance(roots.get(s), str) else roots.get(s, ()))]
    frontier = spark.createDataFrame(start, "source string, root string, home boolean, relpath string, depth int")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    specs = dict(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for row in batch.to_pylist():
                for found in walk(row, specs[row["source"]], folders):
                    rows.append(found)
                    if len(rows) >= 10_000:
                        yield from pa.Table.from_pylist(rows, _ROW).to_batches()
                        rows = []
            yield from pa.Table.from_pylist(rows, _ROW).to_batches()

    rounds = []
    while True:
        level = staged(frontier.repartition(tasks, "source", "root", "relpath").mapInArrow(run, SCHEMA))
        rounds.append(level.where(F.col("state") != "open"))
        frontier = level.where(F.col("state") == "open").select("source", "root", "home", "relpath", "depth")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
