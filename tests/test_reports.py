"""Ordered sinks, previews, the JSON document, globs in large numbers, counters, and streams that keep state."""

import fnmatch
import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leaksieve.functions.rules import builtin_rules
from leaksieve.functions.text import file_uri
from leaksieve.operators import report, suppress
from leaksieve.operators.scan import scan
from leaksieve.operators.staging import drop_staged, staged
from leaksieve.plans.history import scan_history
from leaksieve.streaming.scan_stream import start_scan, windowed_counts

AWS, GIT = "AKIA" + "ABCDEFGH12345678", "ghp_" + "a1B2" * 9


def some(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["zed", "codex", "llm", "odd"]), f"f{rng.randrange(12)}", rng.randrange(1, 9), k % 3, rng.choice([f"x {AWS} {GIT}", f"{GIT}", "clean", f"é {AWS}"])) for k in range(n)]
    return spark.createDataFrame([(s, f, f, line, seq, v) for s, f, line, seq, v in rows], "source string, file string, relpath string, line long, seq int, value string").repartition(5)


def key(sources):
    return lambda r: (sources.index(r.source) if r.source in sources else len(sources), r.source, r.file, r.line, r.seq, r.start, r.rule_idx)


def in_file_order(path, suffix):
    return "".join(p.read_text() for p in sorted(Path(path).glob(f"part-*.{suffix}")))


@pytest.mark.parametrize("path,uri", [("/a b/é%~*+#?.txt", Path("/a b/é%~*+#?.txt").as_uri()), ("rel/a b", "rel/a%20b"), ("s3://bucket/a%20b", "s3://bucket/a%20b"), ("file:///x/a%20b", "file:///x/a%20b"), ("/x/a:b", "file:///x/a%3Ab")])
def test_file_uris(spark, path, uri):
    got = spark.range(1).select(file_uri(F.lit(path))).first()[0]
    assert got == uri or got == uri.replace(":b", "%3Ab")


def test_ordered_sink_and_preview(spark, tmp_path):
    found = scan(some(spark), builtin_rules())
    found = spark.createDataFrame(found.collect(), found.schema).repartition(7)
    sources = ["llm", "codex"]
    want = [(r.source, r.file, r.line, r.rule) for r in sorted(found.collect(), key=key(sources))]
    got = report.ordered(found, sources).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, len(want) + 1)) and [(r.source, r.file, r.line, r.rule) for r in got] == want
    report.write_ordered(found, str(tmp_path / "o"), sources)
    written = [json.loads(x) for x in in_file_order(tmp_path / "o", "json").splitlines()]
    assert [(r["source"], r["file"], r["line"], r["rule"]) for r in written] == want and "match" not in written[0]
    top = report.preview(found, sources).orderBy("position").collect()
    assert [(r.source, r.file, r.line, r.rule) for r in top] == want[:40] and {r.more for r in top} == {len(want) - 40}
    few = report.preview(found.where("source = 'odd' AND file = 'f1'")).collect()
    assert {r.more for r in few} <= {0} and report.preview(found.where("1 = 0")).collect() == [] and report.ordered(found.where("1 = 0")).collect() == []


def test_json_document(spark, tmp_path):
    found = scan(some(spark, 60), builtin_rules())
    found = spark.createDataFrame(found.collect(), found.schema)
    for name, df in (("full", found), ("empty", found.where("1 = 0"))):
        report.write_document(report.json_document(df, builtin_rules(), ["zed"]), str(tmp_path / name))
        text = in_file_order(tmp_path / name, "txt")
        doc = json.loads(text)
        assert AWS not in text and GIT not in text
        assert doc["stats"]["total_findings"] == len(doc["findings"]) == df.count()
        assert sum(g["occurrences"] for g in doc["blast_radius"]) == sum(p["times"] for p in doc["places"]) == df.count()
        assert [f["position"] for f in doc["findings"]] == list(range(1, df.count() + 1)) if doc["findings"] and "position" in doc["findings"][0] else True


def test_many_globs_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    paths = sorted({"/".join(word() for _ in range(rng.randrange(1, 4))) + rng.choice([".txt", ".md", ""]) for _ in range(400)})
    globs = {"".join(rng.choice(["*", "?", "[ab]", "[!c]", word(), "/", ".txt", "[", "]"]) for _ in range(rng.randrange(1, 7))) for _ in range(1500)} | {"", "*a*", paths[0]}
    globs -= {g for g in globs if set(g) <= set("*?/")}  # those match nearly everything
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path for r in suppress.paths_under_globs(df, spark.createDataFrame([(g,) for g in globs], "entry string")).collect()}
    assert got == {p for p in paths if any(fnmatch.fnmatchcase(p, g) for g in globs)}


def test_fifty_thousand_globs(spark):
    globs = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("p/"), F.col("id").cast("string"), F.lit("/*"))).otherwise(F.concat(F.lit("*/"), F.col("id").cast("string"), F.lit(".md"))).alias("entry"))
    paths = spark.range(2_000).select(F.concat(F.lit("p/"), (F.col("id") * 37).cast("string"), F.lit("/"), (F.col("id") * 61).cast("string"), F.lit(".md")).alias("path"))
    got = {r.path for r in suppress.paths_under_globs(paths, globs).collect()}
    inside = lambda n, odd: n < 50_000 and n % 2 == odd
    assert got == {f"p/{i * 37}/{i * 61}.md" for i in range(2_000) if inside(i * 37, 0) or inside(i * 61, 1)}


def test_counters_come_with_the_scan(spark):
    strings = some(spark, 50).unionByName(spark.createDataFrame([("zed", "e", "e", 1, 0, ""), ("zed", "e", "e", 2, 0, None)], "source string, file string, relpath string, line long, seq int, value string"))
    result = scan_history(strings, builtin_rules(), suppress.ignores_of(spark, ["rule:github-pat"]))
    n = result.findings.count()
    want = strings.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("c")).first()
    assert result.counters.get == {"strings": want.n, "characters": want.c, "empty": 2}
    assert n + sum(r.suppressed for r in result.suppressed.collect()) == scan(strings, builtin_rules()).count()


SCHEMA = "source string, file string, relpath string, line long, seq int, value string, ts timestamp"
T0 = datetime(2024, 1, 1)


def send(spark, folder, *rows):
    spark.createDataFrame([("s", f, f, line, 0, v, T0 + timedelta(hours=h)) for f, line, v, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_a_record_sent_twice_gives_one_finding(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ignores = suppress.ignores_of(spark, ["path:skip/*", "rule:jwt", GIT])

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        start_scan(stream, builtin_rules(), out, str(tmp_path / "cp"), ignores=ignores, once=True).awaitTermination()
        return sorted((r.file, r.line, r.rule) for r in spark.read.parquet(out).collect())

    send(spark, folder, ("a", 1, f"x {AWS}", 0), ("skip/a", 1, AWS, 0), ("a", 2, GIT, 0))
    assert run() == [("a", 1, "aws-access-key")]
    send(spark, folder, ("a", 1, f"x {AWS}", 0), ("b", 1, f"x {AWS}", 5), ("a", 1, f"x {AWS[:-1]}9", 0))
    assert run() == [("a", 1, "aws-access-key"), ("a", 1, "aws-access-key"), ("b", 1, "aws-access-key")]
    send(spark, folder, ("a", 1, f"x {AWS}", 9), ("b", 1, f"x {AWS}", 9))
    assert len(run()) == 3


def test_late_rows(spark, tmp_path):
    folder, out, counted = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "counted")

    def run():
        stream = lambda: spark.readStream.schema(SCHEMA).parquet(folder)
        start_scan(stream(), builtin_rules(), out, str(tmp_path / "cp"), once=True, time="ts", late="2 hours").awaitTermination()
        counts = windowed_counts(scan(stream(), builtin_rules()), "ts", late="2 hours")
        counts.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start(counted).awaitTermination()
        return sorted(r.file for r in spark.read.parquet(out).collect()), {r.window_start.hour: r.findings for r in spark.read.parquet(counted).collect()}

    send(spark, folder, ("a", 1, AWS, 1), ("b", 1, AWS, 1))
    run()
    send(spark, folder, ("c", 1, AWS, 10))
    run()
    send(spark, folder, ("late", 1, AWS, 2), ("in time", 1, AWS, 9), ("a", 1, AWS, 10))  # the watermark stands at 8 hours
    files, counts = run()
    assert files == ["a", "a", "b", "c", "in time"]  # a is forgotten by then and counts anew
    send(spark, folder, ("d", 1, AWS, 20))
    assert run()[1] == {1: 2, 9: 1, 10: 2}


def test_staged_tables_are_dropped(spark):
    kept = staged(spark.range(5))
    assert kept.count() == 5 and drop_staged(spark) >= 1 and drop_staged(spark) == 0
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND|FAILED_READ_FILE"):
        kept.count()
