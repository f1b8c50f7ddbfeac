"""Discovery as a table, and files read in pieces: every source, dot names, links, depth, damaged files."""

import io
import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from leaksieve.sources import catalog, files, tree, walk

AWS = "AKIA" + "ABCDEFGH12345678"
#: One file for each binding, below its source's root.
PLANTED = {
    "claude-code": ["projects/p/s.jsonl"], "codex": ["2024/01/r.jsonl"], "opencode": ["opencode.db"], "aider": ["work/app/.aider.chat.history.md"], "cursor": ["User/state.vscdb", "projects/p/a.jsonl"], "windsurf": ["a/b.vscdb", "memories/x/m.md"],
    "cline": ["tasks/1/api_conversation_history.json"], "kilo-code": ["tasks/1/api_conversation_history.json"], "roo-code": ["tasks/1/api_conversation_history.json"], "pearai": ["tasks/1/api_conversation_history.json"],
    "gemini-cli": ["tmp/h/l.jsonl", "tmp/h/chats/c.json"], "qwen-code": ["tmp/h/l.json"], "continue-vscode": ["sessions/a.json"], "open-interpreter": ["conversations/a.json"],
    "github-copilot-chat": ["workspaceStorage/h/chatSessions/a.json", "workspaceStorage/h/chatSessions/a.jsonl", "x/GitHub.copilot-chat/transcripts/t.jsonl", "globalStorage/emptyWindowChatSessions/e.json", "globalStorage/emptyWindowChatSessions/e.jsonl"],
    "openclaw": ["agents/a.jsonl"], "hermes": ["state.db", "logs/a.jsonl"], "goose": ["sessions/sessions.db", "sessions/a.jsonl"], "llm": ["logs.db"], "warp": ["warp.sqlite"], "grok-cli": ["grok.db"], "zed": ["threads/threads.db"], "kiro-cli": ["x/data.db"],
    "crush": ["work/app/.crush/crush.db"], "grok-build": ["sessions/s/chat_history.jsonl"], "codebuff": ["p/chats/chat-messages.json"], "plandex": ["orgs/o/plans/p/conversation/c.json"], "trae": ["a/state.vscdb"], "void": ["a/state.vscdb"],
    "junie": ["sessions/s/a.json", "sessions/s/a.jsonl"], "mentat": ["logs/transcript_1.log"], "jetbrains-ai": ["IDE/workspace/w.xml"],
}
TABLES = {"opencode": ("part", "data"), "cursor": ("ItemTable", "value"), "windsurf": ("cursorDiskKV", "value"), "hermes": ("messages", "content"), "goose": ("messages", "content"), "llm": ("tool_results", "output"), "trae": ("ItemTable", "value"), "void": ("ItemTable", "value")}


def database(path, table="notes", column="body", cells=(AWS,)):
    con = sqlite3.connect(path)
    con.execute(f"CREATE TABLE {table} (id INTEGER PRIMARY KEY, {column} TEXT, other BLOB)")
    con.executemany(f"INSERT INTO {table} ({column}) VALUES (?)", [(c,) for c in cells])
    con.commit()
    con.close()


def plant(root, source, rel):
    path = root / source / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix in (".db", ".vscdb", ".sqlite"):
        database(path, *TABLES.get(source, ("notes", "body")))
    elif path.suffix in (".json", ".jsonl"):
        path.write_text(json.dumps({"m": [{"t": AWS}]}) + "\n")
    else:
        path.write_text(f"first\n{AWS}\n")


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    for source, paths in PLANTED.items():
        for rel in paths:
            plant(root, source, rel)
    return root


def test_every_binding_of_the_32_sources_is_read(spark, planted):
    assert set(PLANTED) == set(catalog.SOURCES) and len(PLANTED) == 32
    (planted / "continue-vscode" / "sessions" / "sessions.json").write_text(json.dumps({"t": AWS}))  # an index, no history
    (planted / "opencode" / "storage").mkdir(exist_ok=True)
    (planted / "opencode" / "storage" / "old.json").write_text(json.dumps({"t": AWS}))  # gives way to the database
    history = catalog.read_history(spark, {s: str(planted / s) for s in PLANTED})
    got = {(r.source, r.relpath) for r in history.strings.where(F.col("value") == AWS).collect()}
    assert got == {(s, p) for s, paths in PLANTED.items() for p in paths}
    assert history.accounts.collect() == []
    rows = {r.source: (r.files, r.detected) for r in catalog.inventory(spark, {s: [str(planted / s), str(planted / "absent")] for s in PLANTED if s != "zed"}).collect()}
    assert rows == {s: (len(p), True) if s != "zed" else (0, False) for s, p in PLANTED.items()}
    assert catalog.detected(catalog.inventory(spark, {"zed": str(planted / "zed"), "codex": str(planted / "absent")})) == ["zed"]


def test_database_else_files(spark, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "old" / "storage" / "x").mkdir(parents=True)
    database(tmp_path / "new" / "opencode.db", "message", "content")
    (tmp_path / "old" / "storage" / "x" / "a.json").write_text(json.dumps({"t": AWS}))
    found = catalog.find_files(spark, {"opencode": [str(tmp_path / "new"), str(tmp_path / "old")]})
    assert sorted(r.relpath for r in found.where("state = 'file'").collect()) == ["opencode.db", "storage/x/a.json"]


def states(found):
    return {(r.relpath, r.state) for r in found.collect()}


def test_what_is_left_out_is_named(spark, tmp_path):
    home, outside = tmp_path / "home", tmp_path / "outside"
    deep = "/".join(f"d{i}" for i in range(13))
    for rel in ("node_modules/x", "a/.git", "Library/p", "a/Library", deep, "dist/p"):
        (home / rel).mkdir(parents=True)
        (home / rel / ".aider.chat.history.md").write_text(AWS)
    (home / "/".join(deep.split("/")[:12]) / ".aider.chat.history.md").write_text(AWS)
    found = tree.discover(spark, catalog.wanted(["aider"]), {"aider": str(home)}, homes=[str(home)])
    at = "/".join(deep.split("/")[:12])
    name = ".aider.chat.history.md"
    assert states(found) == {(f"a/Library/{name}", "file"), (f"{at}/{name}", "file"), (f"dist/p/{name}", "file"), (at, "cut"), ("node_modules", "pruned"), ("a/.git", "pruned"), ("Library", "pruned")}
    assert "Library/p/" + name in {r.relpath for r in tree.discover(spark, catalog.wanted(["aider"]), {"aider": str(home)}).collect()}
    sessions = home / "sessions" / "s"
    sessions.mkdir(parents=True)
    outside.mkdir()
    for p in (outside / "chat_history.jsonl", sessions / "real.jsonl"):
        p.write_text(json.dumps({"t": AWS}) + "\n")
    os.symlink(outside / "chat_history.jsonl", sessions / "chat_history.jsonl")
    os.symlink(sessions / "real.jsonl", sessions / "updates.jsonl")
    os.symlink(outside, sessions / "linked")
    os.symlink(outside / "gone", sessions / "events.jsonl")
    history = catalog.read_history(spark, {"grok-build": str(home)})
    assert {(r.relpath, r.value) for r in history.strings.collect()} == {("sessions/s/updates.jsonl", AWS)}
    assert {(r.relpath, r.note.split(":")[0]) for r in history.accounts.collect()} == {("sessions/s/chat_history.jsonl", "escape"), ("sessions/s/linked", "link")}


def test_frontier_rounds_find_what_one_walk_finds(spark, tmp_path):
    rng = random.Random(3)
    for _ in range(80):
        folder = tmp_path.joinpath(*(rng.choice("abcd") for _ in range(rng.randrange(1, 7))))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{rng.randrange(3)}.jsonl").write_text("{}\n")
    want = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.jsonl")}
    for folders in (1, 7, 2_000):
        found = tree.discover(spark, catalog.wanted(["codex"]), {"codex": str(tmp_path)}, folders=folders)
        assert {r.relpath for r in found.collect()} == want and found.count() == len(want)


@pytest.mark.parametrize("glob,folder,fits", [("tasks/*/x.json", "tasks", True), ("tasks/*/x.json", "tasks/1", True), ("tasks/*/x.json", "tasks/1/b", False), ("tasks/*/x.json", "other", False), ("**/x", "a/b/c", True), ("tmp/**/chats/**/*.json", "tmp", True), ("tmp/**/chats/**/*.json", "t", False), ("state.db", "a", False), ("state.db", "", True)])
def test_folders_that_may_hold_files(glob, folder, fits):
    assert tree.may_hold(folder, glob) is fits


def table_of(spark, *paths):
    return spark.createDataFrame([("s", str(p), os.path.basename(p), os.path.getsize(p)) for p in paths], "source string, file string, relpath string, size long")


def test_lines_by_ranges(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        monkeypatch.setattr(files, "_CHUNK", rng.choice([1, 3, 1 << 20]))
        data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r", b"\r\n", b"\xc3\xa9"]) for _ in range(rng.randrange(30)))
        want = [x for x in __import__("re").findall(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", data)]
        split = rng.randrange(1, 12)
        got = [line for a in range(0, max(len(data), 1), split) for line in files.lines_in(io.BytesIO(data), a, a + split)]
        assert got == want


def test_split_files_number_like_whole_ones(spark, tmp_path):
    rng = random.Random(5)
    text = "".join(rng.choice(["word ", "é", "\n", "\r\n", " ", "\x0c", AWS, "x" * 50]) for _ in range(900))
    (tmp_path / "a.md").write_bytes(text.encode())
    (tmp_path / "empty.md").write_bytes(b"")
    table = table_of(spark, tmp_path / "a.md", tmp_path / "empty.md")
    for split in (97, 1 << 20):
        got = sorted((r.line, r.value) for r in files.text_records(table, split).collect())
        assert got == [(i, x) for i, x in enumerate(text.splitlines(), 1) if x.strip(" ")]
    rows = [json.dumps({"t": f"{i} é"}, ensure_ascii=False) for i in range(300)] + ["", "{bad", '{"z": " "}']
    (tmp_path / "b.jsonl").write_bytes("\r\n".join(rows).encode())
    got = files.jsonl_records(table_of(spark, tmp_path / "b.jsonl"), 64).collect()
    assert sorted((r.line, r.value) for r in got if r.note is None) == [(i + 1, f"{i} é") for i in range(300)] + [(303, " ")]
    assert [(r.line, r.note) for r in got if r.note] == [(302, "a line that isn't JSON")]
    assert [r.note[:10] for r in files.jsonl_records(spark.createDataFrame([("s", str(tmp_path / "gone"), "gone", 5)], table.schema)).collect()] == ["unreadable"]


def random_doc(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind < 3:
        return rng.choice(["", "pl ain", 'q"uo\\te', "é \n\t😀", "{[,:]}", "long " * 40])
    if kind < 5:
        return rng.choice([None, True, False, 1.5e-7, -3, 10**30, float("nan"), float("-inf")])
    if kind < 7:
        return [random_doc(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", 'k"', "é", ""]) + str(i): random_doc(rng, depth + 1) for i in range(rng.randrange(4))}


def test_json_events_equal_the_walker():
    rng = random.Random(6)
    for _ in range(300):
        doc = random_doc(rng)
        data = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])).encode()
        for chunk in (1, 7, 1 << 20):
            assert [(list(p), v) for p, v in files.json_events(io.BytesIO(data), chunk)] == [(p, v) for p, v in walk.leaves(doc)]
    for _ in range(2000):  # what a parser refuses is refused, and nothing else
        data = bytearray(json.dumps({"a": random_doc(rng)}).encode())
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(data))
            data[at : at + 1] = rng.choice([b"", b"]", b"}", b",", b'"', b":", b"1", b"\\", b" ", b"\n"])
        try:
            json.loads(bytes(data))
            good = True
        except ValueError:
            good = False
        try:
            list(files.json_events(io.BytesIO(bytes(data)), rng.choice([1, 5, 100])))
            found = True
        except ValueError:
            found = False
        assert good == found, bytes(data)


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'\xef\xbb\xbf{"a": "x", "a": "y", "n": [{"k": "z"}]}')
    (tmp_path / "bad.json").write_bytes(b'{"a": "seen", "b": ')
    (tmp_path / "deep.json").write_bytes(b"[" * 50_000 + b'"deep"' + b"]" * 50_000)
    got = files.json_records(table_of(spark, tmp_path / "a.json", tmp_path / "bad.json", tmp_path / "deep.json")).collect()
    assert sorted((r.relpath, r.value) for r in got if r.note is None) == [("a.json", "x"), ("a.json", "y"), ("a.json", "z"), ("bad.json", "seen"), ("deep.json", "deep")]
    assert [(r.relpath, r.note) for r in got if r.note] == [("bad.json", "not JSON: the text ends early")]


def test_databases_by_rowid_ranges(spark, tmp_path):
    cells = [f"text {i}" for i in range(95)] + [json.dumps({"a": [AWS]}), '"scalar"', "", "é"]
    database(tmp_path / "a b?#%.db", "part", "data", cells)
    con = sqlite3.connect(tmp_path / "a b?#%.db")
    con.execute("INSERT INTO part (id, data) VALUES (900000000000, 'far'), (-5, 'below')")
    con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID")
    con.execute("INSERT INTO keyed VALUES ('key', 'value')")
    con.commit()
    con.close()
    database(tmp_path / "drift.db", "part", "renamed")
    (tmp_path / "damaged.db").write_bytes(b"SQLite format 3\x00" + b"junk" * 500)
    (tmp_path / "text.db").write_bytes(b"no database")
    table = table_of(spark, *(tmp_path / n for n in ("a b?#%.db", "drift.db", "damaged.db", "text.db")))
    got = files.sqlite_records(table, {"part": ("data", "content"), "absent": ("x",)}, rowids=10).collect()
    strings = {(r.line, tuple(r.keypath), r.value) for r in got if r.note is None}
    want = {(i + 1, ("part", str(i + 1), "data"), c) for i, c in enumerate(cells) if c and i != 95} | {(96, ("part", "96", "data", "a", "0"), AWS), (900000000000, ("part", "900000000000", "data"), "far"), (1, ("part", "-5", "data"), "below")}
    assert strings == want and len([r for r in got if r.note is None]) == len(want)
    notes = {r.relpath: r.note for r in got if r.note}
    assert set(notes) == {"drift.db", "damaged.db", "text.db"} and notes["drift.db"].startswith("schema drift: table part")
    every = files.sqlite_records(table, strict=True).where("relpath like 'a b%'").collect()
    assert {("keyed", "k", "key"), ("keyed", "v", "value")} <= {(r.keypath[0], r.keypath[2], r.value) for r in every} and '"scalar"' not in {r.value for r in every}
