"""Splicing into JSON texts, and validated commits: refused, written, skipped and rolled back files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leaksieve.functions.json_splice import Refused, edited, spliced, string_values
from leaksieve.functions.rules import builtin_rules
from leaksieve.operators import commit, redact
from leaksieve.operators.scan import folded, scan, span_finder, without_overlaps
from leaksieve.plans.history import redact_files
from leaksieve.sources import readers
from leaksieve.sources.walk import leaves

AWS, GIT = "AKIA" + "ABCDEFGH12345678", "ghp_" + "a1B2" * 9


def random_doc(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind < 2:
        return rng.choice(["", "plain", 'q"uo\\te', "é \n\t", "{[,:]}", "😀 x", "a/b"])
    if kind < 5:
        return rng.choice([None, True, 1.5, -3, 10**30, float("nan")])
    if kind == 5:
        return [random_doc(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "0", 'k"', "é", ""]) + str(i): random_doc(rng, depth + 1) for i in range(rng.randrange(4))}


def test_string_values_find_the_walker_s_strings():
    rng = random.Random(1)
    for _ in range(300):
        doc = {"top": random_doc(rng)}
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 3]))
        found = [(list(p), json.loads(text[a:b])) for p, a, b in string_values(text)]
        assert found == [(p, v) for p, v in leaves(doc)]


def test_splice_keeps_every_other_byte():
    rng = random.Random(2)
    for _ in range(200):
        doc = {"top": random_doc(rng), "more": [random_doc(rng), "x"]}
        text = " \n" + json.dumps(doc, indent=rng.choice([None, 1])) + "\n\n"
        paths = [p for p, *_ in string_values(text)]
        chosen = {p: rng.choice(["[R]", 'new "q" \\ é\n']) for p in paths if rng.random() < 0.4}
        new = spliced(text, chosen)
        places = list(string_values(text))
        at, rest = 0, 0
        for (p, a, b), (_, c, d) in zip(places, string_values(new), strict=True):
            assert text[at:a] == new[rest:c]
            assert json.loads(new[c:d]) == chosen.get(p, json.loads(text[a:b]))
            at, rest = b, d
        assert text[at:] == new[rest:]
    assert spliced('{ "a" : "\\u00e9x" , "b":1.50 }', {("a",): "é[R]"}) == '{ "a" : "\\u00e9[R]" , "b":1.50 }'
    assert spliced('"bare"', {(): "[R]"}) == '"[R]"'


@pytest.mark.parametrize("text,path", [("{bad", ("a",)), ('{"a": 1}', ("a",)), ('{"a": "x"}', ("b",)), ('{"a": ["x"]}', ("a", "0")), ('{"a": "x"}', ("a", 0)), ('["x"]', (3,)), ('{"a": "first", "a": "x"}', ("a",)), ("[" * 100_000, (0,))])
def test_splice_refuses(text, path):
    with pytest.raises(Refused):
        spliced(text, {path: "[R]"})


def test_repeated_keys_with_equal_texts_change_together():
    assert spliced('{"a": "x", "a": "x"}', {("a",): "[R]"}) == '{"a": "[R]", "a": "[R]"}'


def write(path, name, text):
    (path / name).write_bytes(text.encode())


def test_whole_json_files(spark, tmp_path):
    good = '{\n   "id" : 1.0, "m": [ {"t":"k ' + AWS + ' é"} ],\t"0": "' + GIT + '", "list": ["' + GIT + '"]}\r\n'
    write(tmp_path, "good.json", good)
    write(tmp_path, "clean.json", '{"a": "nothing"}')
    write(tmp_path, "race.json", '{"a": "' + AWS + '"}')
    paths = [str(tmp_path / n) for n in ("good.json", "clean.json", "race.json")]
    strings = spark.createDataFrame(readers.json_file_strings(spark, paths, "s").collect())
    found = scan(strings, builtin_rules())
    found = spark.createDataFrame(found.collect(), found.schema)
    write(tmp_path, "race.json", '{"a": "' + AWS + '"')  # cut short after the scan
    target = str(tmp_path / "out")
    statuses = {r.file.rsplit("/", 1)[-1]: (r.status, r.note) for r in redact_files("json", readers.whole_files(spark, paths), found, target, "r1").collect()}
    assert statuses == {"good.json": ("ok", None), "clean.json": ("skip", None), "race.json": ("fail", "a change could not be applied")}
    rows = commit.current(spark, target).collect()
    assert [(r.file.rsplit("/", 1)[-1], r.raw) for r in rows] == [("good.json", good.replace(AWS, "[REDACTED:aws-access-key]").replace(GIT, "[REDACTED:github-pat]"))]
    assert [r.raw for r in commit.rolled_back(spark, target).collect()] == [good]


def lines_of(spark, tmp_path):
    return readers.file_lines(spark, [str(tmp_path / "in")])


def test_one_refused_file_leaves_the_others_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {f"{n}.jsonl": f'{{"t": "{n} {AWS}"}}\r\n{{ "odd":  1 }}\nbroken {{\n{{"t": "{GIT}"}}' for n in "abc"} | {"clean.jsonl": '{"t": "x"}\n'}
    for name, text in texts.items():
        write(tmp_path / "in", name, text)
    strings = readers.jsonl_strings(spark, [str(tmp_path / "in")], "s")
    found = spark.createDataFrame((f := scan(strings, builtin_rules())).collect(), f.schema)
    write(tmp_path / "in", "b.jsonl", texts["b.jsonl"].replace('{"t": "b', '{"u": "b'))  # it changed after the scan
    target = str(tmp_path / "out")
    got = {r.file.rsplit("/", 1)[-1]: r for r in redact_files("jsonl", lines_of(spark, tmp_path), found, target, "r1").collect()}
    assert {n: r.status for n, r in got.items()} == {"a.jsonl": "ok", "b.jsonl": "fail", "c.jsonl": "ok", "clean.jsonl": "skip"}
    assert got["a.jsonl"].lines == 4 and got["a.jsonl"].changed_lines == 2 and got["a.jsonl"].bytes_before == len(texts["a.jsonl"])
    now = {}
    for r in sorted(commit.current(spark, target).collect()):
        now[r.file.rsplit("/", 1)[-1]] = now.get(r.file.rsplit("/", 1)[-1], "") + r.raw
    want = lambda n: texts[n].replace(AWS, "[REDACTED:aws-access-key]").replace(GIT, "[REDACTED:github-pat]")
    assert now == {n: want(n) for n in ("a.jsonl", "c.jsonl")}
    assert sorted(r.file.rsplit("/", 1)[-1] for r in commit.audit_log(spark, target).collect()) == ["a.jsonl", "c.jsonl"]
    assert commit.vault(spark, target).count() == 4
    assert "".join(r.raw for r in sorted(commit.rolled_back(spark, target).where("file like '%a.jsonl'").collect())) == texts["a.jsonl"]
    again = redact_files("jsonl", lines_of(spark, tmp_path), found, target, "r2").collect()
    assert {r.status for r in again} == {"skip", "fail"} and {r.note for r in again} == {None, "already written", "a change could not be applied"}
    assert {p.name for p in (tmp_path / "out" / "files").iterdir()} == {"run=r1"}
    with pytest.raises(ValueError):
        commit.commit(commit.current(spark, target), target, "../x", "text")


def test_a_run_without_audit_is_unseen(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1, "new\n", True, False, "old\n")], "file string, line long, raw string, changed boolean, failed boolean, was string")
    target = str(tmp_path)
    rows.select("file", "line", "raw").write.parquet(f"{target}/files/run=r0")  # it broke off before the audit
    assert commit.current(spark, target).count() == 0
    assert [r.status for r in commit.commit(rows, target, "r0", "text").collect()] == ["ok"]
    assert [r.raw for r in commit.current(spark, target).collect()] == ["new\n"]


def test_text_lines_fold_or_refuse(spark):
    lines = spark.createDataFrame([("f", 1, "a\r\n"), ("f", 2, "b"), ("g", 1, "c\n"), ("h", 1, "d")], "file string, line long, raw string")
    changes = spark.createDataFrame([("f", 1, "A"), ("f", 1, "A"), ("g", 1, "X"), ("g", 1, "Y"), ("h", 1, "two\nlines")], "file string, line long, new_value string")
    got = {(r.file, r.line): (r.raw, r.changed, r.failed, r.was) for r in redact.redact_text_lines(lines, changes).collect()}
    assert got == {("f", 1): ("A\r\n", True, False, "a\r\n"), ("f", 2): ("b", False, False, None), ("g", 1): ("c\n", False, True, None), ("h", 1): ("d", False, True, None)}


def test_texts_that_changed_since_the_scan_fail(spark):
    lines = spark.createDataFrame([("f", 1, f"a {AWS} {GIT}\r\n"), ("f", 2, f"é {AWS}"), ("g", 1, f"moved {AWS}\n"), ("h", 1, "short")], "file string, line long, raw string")
    found = [("f", 1, 2, 22, AWS, "aws-access-key"), ("f", 1, 23, 63, GIT, "github-pat"), ("f", 2, 2, 22, AWS, "aws-access-key"), ("g", 1, 2, 22, AWS, "aws-access-key"), ("h", 1, 2, 22, AWS, "aws-access-key")]
    findings = spark.createDataFrame([(f, line, [str(line)], a, b, m, r) for f, line, a, b, m, r in found], "file string, line long, keypath array<string>, start int, end int, match string, rule string")
    got = {(r.file, r.line): (r.raw, r.failed) for r in redact.redact_text_lines(lines, redact.edits_of(findings)).collect()}
    assert got == {("f", 1): ("a [REDACTED:aws-access-key] [REDACTED:github-pat]\r\n", False), ("f", 2): ("é [REDACTED:aws-access-key]", False), ("g", 1): (f"moved {AWS}\n", True), ("h", 1): ("short", True)}
    doc = f'{{"a": "x {AWS}", "b": ["{GIT}"]}}'
    edits = lambda was, a: [{"start": a, "end": a + len(was), "was": was, "text": "[R]"}]
    from functools import partial

    assert spliced(doc, {("a",): partial(edited, edits=edits(AWS, 2)), ("b", 0): partial(edited, edits=edits(GIT, 0))}) == '{"a": "x [R]", "b": ["[R]"]}'
    with pytest.raises(Refused):
        spliced(doc, {("a",): partial(edited, edits=edits(AWS, 1))})


def test_names_that_are_taken(spark):
    df = spark.createDataFrame([("x " + AWS, 5, 6)], "value string, _hits int, __hits int")
    done = redact.redact_column(df, "value", builtin_rules()).first()
    assert (done._hits, done["__hits"], done.n_redacted) == (5, 6, 1)
    with pytest.raises(ValueError):
        redact.redact_column(df.withColumnRenamed("_hits", "n_redacted"), "value", builtin_rules())


def test_json_column_equals_the_way_by_findings(spark):
    rng = random.Random(9)
    atoms = [AWS, GIT, "plain é", 'q"uo\\te', "\n", f"key={AWS}", f"{GIT}{AWS}", " ", "sk-" + "a1" * 30]
    docs = [{"a": [rng.choice(["x", " ".join(rng.choice(atoms) for _ in range(rng.randrange(6)))]) for _ in range(3)], GIT: 1, "b": {"c": AWS if k % 3 else None}} for k in range(120)]
    texts = [json.dumps(d, ensure_ascii=k % 2 == 0, indent=k % 4 or None) for k, d in enumerate(docs)] + ["{bad " + AWS, "", None, f'"{AWS}"', f'{{"a": "{AWS}", "a": "x {GIT}"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r.id: r for r in redact.redact_json_column(df, "text", builtin_rules()).collect()}
    for k, text in enumerate(texts[:120]):
        new = json.loads(got[k].redacted)
        values = spark_free_redaction(docs[k])
        assert new == values and not got[k].failed and (got[k].redacted == text) == (values == docs[k])
    assert [(got[k].redacted, got[k].n_redacted, got[k].failed) for k in (120, 121, 122)] == [(texts[120], 0, True), ("", 0, True), (None, 0, False)]
    assert got[123].redacted == '"[REDACTED:aws-access-key]"' and got[124].redacted == '{"a": "[REDACTED:aws-access-key]", "a": "x [REDACTED:github-pat]"}' and got[124].n_redacted == 2
    some = redact.redact_json_column(df.where("id = 124"), "text", builtin_rules(), only=["github-pat"]).first()
    assert some.redacted == f'{{"a": "{AWS}", "a": "x [REDACTED:github-pat]"}}' and some.n_redacted == 1


def spark_free_redaction(doc):
    """Every string value with its hits replaced, by the fold over the finder's hits."""
    names = {r.order: r.rule for r in builtin_rules()}
    spans = span_finder(tuple(builtin_rules()))
    if isinstance(doc, dict):
        return {k: spark_free_redaction(v) for k, v in doc.items()}
    if isinstance(doc, list):
        return [spark_free_redaction(v) for v in doc]
    if not isinstance(doc, str):
        return doc
    for start, k, end in reversed(folded(spans(doc))):
        doc = doc[:start] + f"[REDACTED:{names[k]}]" + doc[end:]
    return doc


def test_folds_agree(spark):
    rng = random.Random(12)
    rows = [[(rng.randrange(12), rng.randrange(4), 0) for _ in range(rng.randrange(6))] for _ in range(200)]
    rows = [sorted({(a, k, a + rng.randrange(1, 6)) for a, k, _ in r}) for r in rows]
    df = spark.createDataFrame([(i, [(a, k, e, "") for a, k, e in r]) for i, r in enumerate(rows)], "id int, hits array<struct<start:int,idx:int,end:int,value:string>>")
    got = {r.id: [(h.start, h.idx, h.end) for h in r.kept] for r in df.select("id", without_overlaps(F.col("hits")).alias("kept")).collect()}
    assert got == {i: folded(r) for i, r in enumerate(rows)}
