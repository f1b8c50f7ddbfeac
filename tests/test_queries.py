"""Registered queries on small tables of odd rows, against their DuckDB SQL."""

from collections import Counter

import pytest

from leaksieve.operators import suppress
from leaksieve.operators.scan import scan
from leaksieve.plans.queries import QUERIES, SQL, rules
from leaksieve.streaming.scan_stream import without_ignored

duckdb = pytest.importorskip("duckdb")
TOKEN = 'token = "' + "0123456789" * 4 + '"'


def both(spark, tmp_path, name, rows):
    """The rows of a query and of its SQL over documents (doc_id, text, lang, source)."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = con.sql(f"SELECT {', '.join(found.columns)} FROM ({SQL[name]})").fetchall()
        columns = con.sql(SQL[name]).columns
    assert sorted(columns) == sorted(found.columns)
    return Counter(map(tuple, found.collect())), Counter(map(tuple, wanted))


def test_blast_radius_names_all_places(spark, tmp_path):
    rows = [(1, f"a {TOKEN} b {TOKEN} ", "en", "s"), (2, f"c {TOKEN} ", "en", "s"), (3, f"d {TOKEN} ", "en", "other"), (7, None, "en", "s")]
    got, wanted = both(spark, tmp_path, "blast_radius", rows)
    assert got == wanted
    assert {(r[0], r[-1]) for r in got} == {("s", "s/1.txt,s/1.txt,s/2.txt"), ("other", "other/3.txt")}


def test_sarif_of_a_source_of_many_findings(spark, tmp_path):
    rows = [(7 * k, f"a {k}", "en", "hot") for k in range(1, 5102)] + [(11, f"b {TOKEN} c", "en", "cold"), (13, "d", "en", "none")]
    got, wanted = both(spark, tmp_path, "sarif_documents", rows)
    assert len(got) == 2 and got == wanted


def test_planted_seed_phrases_among_others(spark, tmp_path):
    rows = [(13, "plain é", "en", "s"), (26, "bege " * 30, "en", "s"), (27, "bege " * 30, "en", "s"), (39, None, "en", "s"), (40, None, "en", "s"), (52, "", "en", "s")]
    got, wanted = both(spark, tmp_path, "seed_phrase_planted", rows)
    assert got == wanted and sorted(r[0] for r in got) == [13, 26, 39, 52]


def test_ignore_entries_of_a_stream_run_no_python(spark):
    texts = [("s", f, f, 1, f"x {TOKEN} ") for f in ("src1/7.txt", "src2/7.txt", "src3/8.txt")]
    found = scan(spark.createDataFrame(texts, "source string, file string, relpath string, line long, value string"), rules())
    kept = without_ignored(found, suppress.ignores_of(spark, ["rule:github-pat", "path:src1*", "src3/8.txt:1:generic-token"]))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "SortMergeJoin" not in plan
    assert [r.file for r in kept.collect()] == ["src2/7.txt"]
    assert without_ignored(found, suppress.ignores_of(spark, [])).count() == 3
