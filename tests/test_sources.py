import json

from pyspark.sql import functions as F

from leaksieve.functions.rules import builtin_rules
from leaksieve.operators.scan import scan
from leaksieve.plans.history import redact_jsonl, scan_history, write_reports
from leaksieve.sources import catalog, readers, walk
from leaksieve.streaming.scan_stream import start_scan, text_stream

AWS = "AKIA" + "ABCDEFGH12345678"


def test_jsonl_lines_are_physical(spark, tmp_path):
    rows = [json.dumps({"role": "user", "text": "a b\u0085c"}, ensure_ascii=False), "", "{bad", json.dumps({"m": {"c": ["x", {"t": AWS}, 3, None]}})]
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(rows[:2]).encode() + b"\n" + rows[2].encode() + b"\r" + rows[3].encode())
    got = readers.jsonl_strings(spark, [str(tmp_path)], "s", str(tmp_path)).collect()
    assert sorted((r.line, r.path, r.value) for r in got) == [(1, '["role"]', "user"), (1, '["text"]', "a b\u0085c"), (4, '["m", "c", 0]', "x"), (4, '["m", "c", 1, "t"]', AWS)]
    assert {r.relpath for r in got} == {"a.jsonl"}
    assert readers.jsonl_quality(spark, [str(tmp_path)]).first()["unparseable_lines"] == 1


def test_split_lines_number_like_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    got = {r.line: r.raw for r in readers.split_lines(spark, [str(tmp_path)]).collect()}
    assert got == {i + 1: f"line {i}" for i in range(500)}


def test_walk_traps():
    assert list(walk.leaves("bare")) == [] and list(walk.leaves("bare", scalars=True)) == [([], "bare")]
    assert list(walk.leaves({"a": ["x", {"b": "y"}], "c": 1})) == [(["a", 0], "x"), (["a", 1, "b"], "y")]


def test_text_lines_break_at_wide_separators(spark, tmp_path):
    (tmp_path / "a.md").write_text("one two\n\n three \x0cfour\n", encoding="utf-8")
    got = readers.text_strings(spark, [str(tmp_path)], "s").collect()
    assert sorted((r.line, r.value) for r in got) == [(1, "one"), (2, "two"), (4, " three "), (5, "four")]


def test_table_strings_take_nested_columns(spark):
    df = spark.createDataFrame([(1, ("a", 2), "b"), (2, (None, 3), " ")], "id int, s struct<x string, n int>, y string")
    got = walk.table_strings(df, ["id"], "t").collect()
    assert sorted((r.file, ".".join(r.keypath), r.value) for r in got) == [("1", "s.x", "a"), ("1", "y", "b")]


def test_catalog_reads_and_lists(spark, tmp_path):
    assert len(catalog.SOURCES) == 32
    (tmp_path / "projects" / "p").mkdir(parents=True)
    (tmp_path / "projects" / "p" / "s.jsonl").write_text(json.dumps({"t": AWS}) + "\n")
    (tmp_path / "projects" / "p" / "s.txt").write_text("no")
    got = catalog.read_sources(spark, {"claude-code": str(tmp_path), "codex": str(tmp_path / "absent")})
    assert [(r.source, r.relpath, r.value) for r in got.collect()] == [("claude-code", "projects/p/s.jsonl", AWS)]
    rows = {r.source: (r.files, r.detected) for r in catalog.inventory(spark, {"claude-code": str(tmp_path)}).collect()}
    assert rows["claude-code"] == (1, True) and rows["codex"] == (0, False) and len(rows) == 32


def test_redact_jsonl_keeps_other_lines(spark, tmp_path):
    raw = [json.dumps({"t": f"k {AWS} é"}, ensure_ascii=False) + "\r\n", '{ "odd":   1 }\n', "broken {\n"]
    (tmp_path / "a.jsonl").write_bytes("".join(raw).encode())
    lines, strings = readers.file_lines(spark, [str(tmp_path)]), readers.jsonl_strings(spark, [str(tmp_path)], "s")
    found = scan_history(strings, builtin_rules()).findings
    out, statuses = redact_jsonl(lines, found)
    assert [r.raw for r in out.orderBy("line").collect()] == ['{"t": "k [REDACTED:aws-access-key] é"}\r\n', raw[1], raw[2]]
    assert [(r.status, r.note) for r in statuses.collect()] == [("ok", None)]


def test_reports_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"x {AWS}\nclean\n")
    strings = readers.text_strings(spark, [str(tmp_path / "in")], "s")
    write_reports(scan_history(strings, builtin_rules()), builtin_rules(), str(tmp_path / "out"))
    for f in (tmp_path / "out").rglob("part-*"):
        assert AWS not in f.read_text()
    q = start_scan(text_stream(spark, str(tmp_path / "in"), "s"), builtin_rules(), str(tmp_path / "found"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.rule for r in spark.read.parquet(str(tmp_path / "found")).collect()] == ["aws-access-key"]
    assert scan(strings, builtin_rules()).where(F.col("rule") == "aws-access-key").count() == 1
