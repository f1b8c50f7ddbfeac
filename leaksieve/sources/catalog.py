"""The catalog of history sources: what lies where, in which format. Roots are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.operators.staging import staged
from leaksieve.sources import files, tree


class Binding(NamedTuple):
    """One glob of a source; columns: wanted SQLite columns by table (None: all text columns)."""

    source: str
    format: str
    glob: str
    columns: dict[str, tuple[str, ...]] | None = None
    exclude: str = ""  # a file name that isn't history
    instead: bool = False  # read only where the root has no file of the source's other bindings


_LLM = {"responses": ("prompt", "system", "response", "reasoning"), "fragments": ("content", "source"), "conversations": ("name",), "tool_calls": ("arguments",), "tool_results": ("output", "exception"), "schemas": ("content",)}
_VSCDB = {"cursorDiskKV": ("value",), "ItemTable": ("value",)}

# Source, format, glob below the source's root, and the text columns of databases with known tables.
BINDINGS = [
    Binding("claude-code", "jsonl", "projects/**/*.jsonl"),
    Binding("codex", "jsonl", "**/*.jsonl"),
    Binding("opencode", "sqlite", "opencode.db", {"part": ("data", "content"), "message": ("data", "metadata", "metadata_part"), "session": ("title",)}),
    Binding("opencode", "json", "storage/**/*.json", instead=True),
    Binding("aider", "text", "**/.aider.chat.history.md"),
    Binding("cursor", "sqlite", "**/*.vscdb", _VSCDB),
    Binding("cursor", "jsonl", "projects/**/*.jsonl"),
    Binding("windsurf", "sqlite", "**/*.vscdb", _VSCDB),
    Binding("windsurf", "text", "memories/**/*.md"),
    Binding("cline", "json", "tasks/*/api_conversation_history.json"),
    Binding("kilo-code", "json", "tasks/*/api_conversation_history.json"),
    Binding("roo-code", "json", "tasks/*/api_conversation_history.json"),
    Binding("pearai", "json", "tasks/*/api_conversation_history.json"),
    Binding("gemini-cli", "jsonl", "tmp/**/*.jsonl"),
    Binding("gemini-cli", "json", "tmp/**/chats/**/*.json"),
    Binding("qwen-code", "json", "tmp/**/*.json"),
    Binding("continue-vscode", "json", "sessions/*.json", exclude="sessions.json"),
    Binding("open-interpreter", "json", "conversations/*.json"),
    Binding("github-copilot-chat", "json", "workspaceStorage/**/chatSessions/*.json"),
    Binding("github-copilot-chat", "jsonl", "workspaceStorage/**/chatSessions/*.jsonl"),
    Binding("github-copilot-chat", "jsonl", "**/GitHub.copilot-chat/transcripts/*.jsonl"),
    Binding("github-copilot-chat", "json", "globalStorage/emptyWindowChatSessions/*.json"),
    Binding("github-copilot-chat", "jsonl", "globalStorage/emptyWindowChatSessions/*.jsonl"),
    Binding("openclaw", "jsonl", "**/*.jsonl"),
    Binding("hermes", "sqlite", "state.db", {"messages": ("content",)}),
    Binding("hermes", "jsonl", "**/*.jsonl"),
    Binding("goose", "sqlite", "sessions/sessions.db", {"messages": ("content",)}),
    Binding("goose", "jsonl", "sessions/*.jsonl"),
    Binding("llm", "sqlite", "logs.db", _LLM),
    Binding("warp", "sqlite", "warp.sqlite"),
    Binding("grok-cli", "sqlite", "grok.db"),
    Binding("zed", "sqlite", "threads/threads.db"),
    Binding("kiro-cli", "sqlite", "**/*.db"),
    Binding("crush", "sqlite", "**/.crush/crush.db"),
    Binding("grok-build", "jsonl", "sessions/**/{chat_history,updates,events}.jsonl"),
    Binding("codebuff", "json", "**/chat-messages.json"),
    Binding("plandex", "json", "orgs/*/plans/*/conversation/*.json"),
    Binding("trae", "sqlite", "**/*.vscdb", _VSCDB),
    Binding("void", "sqlite", "**/*.vscdb", _VSCDB),
    Binding("junie", "json", "sessions/**/*.json"),
    Binding("junie", "jsonl", "sessions/**/*.jsonl"),
    Binding("mentat", "text", "logs/transcript_*.log"),
    Binding("jetbrains-ai", "text", "*/workspace/*.xml"),
]
SOURCES = tuple(dict.fromkeys(b.source for b in BINDINGS))
# Folders never entered when projects are searched, those skipped at the top of a home folder only, and the depth of that search.
SKIPPED = (".git", "node_modules", ".venv", "venv", "__pycache__", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache", ".npm", ".yarn", ".pnpm-store", ".cargo", ".rustup")
SKIPPED_AT_HOME = ("AppData", "Library", ".Trash", "Trash", ".local")
PROJECT_DEPTH = 12
#: Sources that lie beside projects, and those whose links must stay below a folder.
PROJECTS = ("aider", "crush")
CONTAINED = {"grok-build": "sessions"}

Roots = Mapping[str, str | Sequence[str]]


def wanted(sources: Sequence[str] = SOURCES, depth: int = PROJECT_DEPTH) -> dict[str, tree.Wanted]:
    """What to look for below each source's roots; only searches among projects skip folders and end at a depth."""
    out = {}
    for s in sources:
        globs = tuple((i, b.glob, b.exclude) for i, b in enumerate(BINDINGS) if b.source == s)
        out[s] = tree.Wanted(globs, SKIPPED, SKIPPED_AT_HOME, depth, CONTAINED.get(s)) if s in PROJECTS else tree.Wanted(globs, contained=CONTAINED.get(s))
    return out


def find_files(spark: SparkSession, roots: Roots, sources: Sequence[str] = SOURCES, homes: Sequence[str] = (), depth: int = PROJECT_DEPTH) -> DataFrame:
    """The discovered files and what was left out (tree.SCHEMA) of the sources that have roots. Bindings that stand in for another give way to it, root by root."""
    found = tree.discover(spark, wanted([s for s in sources if s in roots], depth), roots, homes)
    instead = [i for i, b in enumerate(BINDINGS) if b.instead]
    first = found.where((F.col("state") == "file") & ~F.col("binding").isin(*instead)).select("source", "root").distinct().withColumn("_taken", F.lit(True))
    joined = found.join(first, ["source", "root"], "left")
    return joined.where(~(F.coalesce(F.col("binding").isin(*instead), F.lit(False)) & F.coalesce("_taken", F.lit(False)))).drop("_taken")


def read_files(found: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Records (files.RECORD) of all discovered files: strings, and accounts of what could not be read or was left out (those with a note)."""
    have = {r.binding for r in found.where(F.col("state") == "file").select("binding").distinct().collect()}  # at most one for each binding of the catalog
    parts = []
    for how in ("jsonl", "text", "json"):
        if some := [i for i in have if BINDINGS[i].format == how]:
            parts.append(_READERS[how](found.where((F.col("state") == "file") & F.col("binding").isin(*some))))
    by_columns: dict[str, list[int]] = {}
    for i in sorted(have):
        if BINDINGS[i].format == "sqlite":
            by_columns.setdefault(repr(BINDINGS[i].columns), []).append(i)
    for some in by_columns.values():
        parts.append(files.sqlite_records(found.where((F.col("state") == "file") & F.col("binding").isin(*some)), BINDINGS[some[0]].columns))
    left = found.where(~F.col("state").isin("file", "pruned"))
    none = F.array().cast("array<string>")
    parts.append(left.select("source", "file", "relpath", F.lit(0).cast("long").alias("line"), F.lit(0).alias("seq"), none.alias("keypath"), F.lit("[]").alias("path"), F.lit(None).cast("string").alias("value"), F.concat_ws(": ", "state", "note").alias("note")))
    return reduce(DataFrame.unionByName, [p.select(*files.RECORD) for p in parts])


_READERS = {"jsonl": files.jsonl_records, "text": files.text_records, "json": files.json_records}


class History(NamedTuple):
    """strings: what is scanned. accounts: source, file, relpath, note, times: what was left out or could not be read."""

    strings: DataFrame
    accounts: DataFrame


def read_history(spark: SparkSession, roots: Roots, sources: Sequence[str] = SOURCES, homes: Sequence[str] = ()) -> History:
    """Discover and read; the records are written once, for strings and accounts alike."""
    records = staged(read_files(find_files(spark, roots, sources, homes), sources))
    accounts = records.where(F.col("note").isNotNull()).groupBy("source", "file", "relpath", "note").agg(F.count(F.lit(1)).alias("times"))
    return History(records.where(F.col("note").isNull()).drop("note"), accounts)


def read_sources(spark: SparkSession, roots: Roots, sources: Sequence[str] = SOURCES) -> DataFrame:
    """The string records of all sources with a root (a source may have several)."""
    return read_history(spark, roots, sources).strings


def inventory(spark: SparkSession, roots: Roots, homes: Sequence[str] = ()) -> DataFrame:
    """source, files, bytes, newest, detected, left_out for every source of the catalog."""
    found = find_files(spark, roots, homes=homes)
    is_file = F.col("state") == "file"
    per = found.groupBy("source").agg(
        F.count_if(is_file).alias("files"), F.sum(F.when(is_file, F.col("size"))).alias("bytes"), F.max(F.when(is_file, F.col("modified"))).alias("newest"), F.count_if(F.col("state").isin("cut", "link", "escape", "unreadable")).alias("left_out")
    )
    catalog = spark.createDataFrame([(s,) for s in SOURCES], "source string").join(per, "source", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return catalog.select("source", number("files"), number("bytes"), "newest", (F.coalesce("files", F.lit(0)) > 0).alias("detected"), number("left_out"))


def detected(listed: DataFrame) -> list[str]:
    """The sources of an inventory that have history (at most as many as the catalog has)."""
    return sorted(r.source for r in listed.where("detected").select("source").collect())
