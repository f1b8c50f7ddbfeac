import re

import pytest
from pyspark.sql import functions as F

from leaksieve.functions import rules as R
from leaksieve.functions import seed_words
from leaksieve.functions import text as T
from leaksieve.operators import budget, redact, report, seed_phrase, suppress
from leaksieve.operators.scan import scan, span_finder

AWS = "AKIA" + "ABCDEFGH12345678"
GIT = "ghp" + "_" + "a1B2" * 9


def strings(spark, values):
    rows = [("s", f"f{i}", f"f{i}", 1, 0, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "source string, file string, relpath string, line long, seq int, value string")


def hits(spark, values, rules=None, **how):
    found = scan(strings(spark, values), rules or R.builtin_rules(), **how)
    return sorted((r.file, r.rule, r.start, r.end, r.match) for r in found.collect())


def test_rule_table():
    rules = R.builtin_rules()
    assert len(rules) == 214 and [r.order for r in rules] == list(range(214))
    assert len({r.rule for r in rules}) == 214 and all(r.rotation for r in rules)
    for r in rules:
        re.compile(r.pattern)


def test_unknown_rules_and_twice_defined():
    rules = R.builtin_rules()
    with pytest.raises(ValueError):
        R.select_rules(rules, only=["nope"])
    with pytest.raises(ValueError):
        R.select_rules(rules, only=["openai"], exclude=["jwt"])
    with pytest.raises(ValueError):
        R.with_pack(rules, [rules[0]])


def test_spans_masks_and_empty_values(spark):
    text = f"x {AWS} und é {GIT} end"
    assert hits(spark, [text, "", None, "plain"]) == [("f0", "aws-access-key", 2, 22, AWS), ("f0", "github-pat", 29, 69, GIT)]
    masked = {r.masked for r in scan(strings(spark, [text]), R.builtin_rules()).collect()}
    assert masked == {"AKIAAB" + "*" * 8 + "5678", "ghp_a1" + "*" * 8 + "a1B2"}


def test_hits_equal_every_pattern_tried_alone(spark):
    texts = [f"a={AWS}\n", f"'{GIT}'", f"{GIT}_", "cohere_key = " + "a1" * 20 + " ", "curl -u user:passw0rd https://x.y", "SK" + "0f" * 16, "lob: live_" + "ab" * 17 + "c;", "postgres://u:p@h/d", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12]
    texts += ["é " + t for t in texts]
    every = [r for r in R.builtin_rules() if r.pattern]
    spans = span_finder(tuple(R.builtin_rules()))
    for t in texts:
        assert sorted(spans(t)) == sorted((m.start(), r.order, m.end()) for r in every for m in re.finditer(r.pattern, t))
    found = {f for f, *_ in hits(spark, texts)}
    assert found == {f"f{i}" for i, t in enumerate(texts) if any(re.search(r.pattern, t) for r in every)} and len(found) > 8


@pytest.mark.parametrize("text", ["a" * 50_000, "eyJ" + "A" * 60_000, "curl " * 10_000, "key=" * 15_000, "://" * 20_000, "\\" * 40_000, "sk-" * 15_000 + "-H", "-----BEGIN PRIVATE KEY-----" * 1500])
def test_pathological_texts_take_less_than_a_second(text):
    import time

    spans = span_finder(tuple(R.builtin_rules()))
    spans("warm")
    began = time.process_time()
    spans(text)
    assert time.process_time() - began < 1


def test_overlaps_fold_in_order(spark):
    pack = [R.Rule(0, "long", "L", "abcdef", ("abc",)), R.Rule(1, "short", "S", "bc", ("bc",)), R.Rule(2, "tail", "T", "fghi", ("fgh",)), R.Rule(3, "tie", "T", "abcdef", ())]
    assert hits(spark, ["abcdefghi abc fghi"], pack) == [("f0", "long", 0, 6, "abcdef"), ("f0", "short", 11, 13, "bc"), ("f0", "tail", 14, 18, "fghi")]


def test_marks_inside_a_text_are_no_hits(spark):
    assert hits(spark, [f"x {AWS}"]) == [("f0", "aws-access-key", 4, 24, AWS)]


def test_prefilter_loses_nothing(spark):
    texts = [f"k {AWS}", f"{GIT}", "dapi" + "a0" * 16, "none"]
    some = [r for r in R.builtin_rules() if r.rule in ("aws-access-key", "github-pat", "databricks-api-token")]
    assert hits(spark, texts, some) == hits(spark, texts, [r._replace(anchors=(), gate=None) for r in some])


@pytest.mark.parametrize(
    "line,kind", [("", None), ("# x", None), ("rule: openai", ("rule", "openai")), ("path:src/*.py", ("path", "src/*.py")), ("a/b.txt:12:openai", ("fingerprint", "a/b.txt:12:openai")), ("path:x:12:r", ("fingerprint", "path:x:12:r")), ("secret", ("value", "secret"))]
)
def test_ignore_lines(spark, line, kind):
    got = suppress.ignores_of(spark, [line]).collect()
    assert [tuple(r) for r in got] == ([kind] if kind else [])


def test_suppression_counts(spark):
    found = scan(strings(spark, [AWS, AWS, GIT, GIT]), R.builtin_rules())
    marked = suppress.with_suppression(found, suppress.ignores_of(spark, ["f0:1:aws-access-key", "path:f[23]", "other"]))
    assert sorted((r.file, r.suppressed) for r in marked.collect()) == [("f0", True), ("f1", False), ("f2", True), ("f3", True)]


@pytest.mark.parametrize("glob,path,fits", [("*.py", "a/b.py", True), ("src/?.py", "src/ab.py", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False)])
def test_globs(spark, glob, path, fits):
    assert spark.range(1).select(F.lit(path).rlike(T.glob_pattern(glob))).first()[0] is fits


def test_templates():
    assert T.check_template("<{rule}>")
    for bad in ("", "{x}", "a/b", "a\nb", "{rule!r}"):
        with pytest.raises(ValueError):
            T.check_template(bad)


def test_redact_restore_and_idempotence(spark):
    df = strings(spark, [f"a {AWS} é {GIT} z", "clean", None])
    done = redact.redact_column(df, "value", R.builtin_rules())
    got = {r.file: (r.redacted, r.n_redacted) for r in done.collect()}
    assert got["f0"] == ("a [REDACTED:aws-access-key] é [REDACTED:github-pat] z", 2) and got["f1"] == ("clean", 0) and got["f2"] == (None, 0)
    vault = redact.vault_rows(done, ["file"], "value", "redacted", "r1")
    assert vault.count() == 1 and redact.unpurged(vault).first()["originals"] == 1
    back = redact.restore(done.select("file", F.col("redacted").alias("value")), vault, ["file"], "value", "r1")
    assert {r.file: r.value for r in back.collect()} == {r.file: r.value for r in df.collect()}
    assert redact.purge(vault, "r1").count() == 0


def test_reports(spark):
    found = scan(strings(spark, [AWS, AWS, GIT]), R.builtin_rules())
    assert {(r.scope, r.name, r.findings) for r in report.stats(found).collect()} == {("total", "", 3), ("rule", "aws-access-key", 2), ("rule", "github-pat", 1), ("source", "s", 3)}
    top = report.blast_radius(found, R.builtin_rules()).where("rule = 'aws-access-key'").first()
    assert top.occurrences == 2 and top.files == 2 and top.rotation.startswith("Rotate")
    assert [(p.file, p.line, p.times) for p in report.exposed_places(found).where(F.col("masked") == top.masked).orderBy("file").collect()] == [("f0", 1, 1), ("f1", 1, 1)]
    doc = report.sarif(found, R.builtin_rules()).first()["value"]
    assert AWS not in doc and GIT not in doc and '"version":"2.1.0"' in doc
    parts = report.sarif(scan(strings(spark, [AWS] * 40), R.builtin_rules()), R.builtin_rules(), results=10).collect()
    assert len(parts) > 2 and sum(p.value.count('"ruleId"') for p in parts) == 40
    states = {r.fingerprint: r.state for r in report.compare(found.where("file <> 'f0'"), found.where("file <> 'f2'")).collect()}
    assert states == {"f0:1:aws-access-key": "new", "f1:1:aws-access-key": "same", "f2:1:github-pat": "gone"}
    assert report.finding_set_hash(found).first() == report.finding_set_hash(found.repartition(7)).first()


def test_budget_keeps_the_string_that_exceeds_it(spark):
    df = spark.createDataFrame([("s", "f", i, "x" * 4) for i in range(5)], "source string, file string, seq int, value string")
    assert sorted(r.seq for r in budget.within_budget(df, 8).collect()) == [0, 1, 2]
    assert budget.truncated_files(df, 8).count() == 1


RULED = [f"{a}{b}{c}{d}" for a in "bcdfghjklmnprstv" for b in "aeio" for c in "bcdfghjklmnprstv" for d in "ae"]


def seed(entropy):
    import hashlib

    bits = "".join(f"{x:08b}" for x in entropy) + f"{hashlib.sha256(entropy).digest()[0]:08b}"[: len(entropy) // 4]
    return [RULED[int(bits[i : i + 11], 2)] for i in range(0, len(bits), 11)]


def test_seed_phrases(spark):
    phrase, long = seed(bytes(range(16))), seed(bytes(range(7, 39)))
    bad = phrase[:-1] + [RULED[(RULED.index(phrase[-1]) + 1) % 2048]]
    texts = ["Key: " + " ".join(phrase) + ". Thanks", ",\n".join(phrase).upper(), " ".join(bad), "one two three", None, "", " ".join(long), " ".join(phrase + long), "    ".join(phrase)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    got = {r.id: (r.match.lower(), r.masked, r.n_words) for r in seed_phrase.seed_phrases(df, RULED).where("id <> 7").collect()}
    ends = lambda p: f"{p[0]} …[{len(p)} words]… {p[-1]}"
    assert got == {0: (" ".join(phrase), ends(phrase), 12), 1: (",\n".join(phrase), ends(phrase), 12), 6: (" ".join(long), ends(long), 24)}
    assert [r.n_words for r in seed_phrase.seed_phrases(df.where("id = 7"), RULED).orderBy("start").collect()] == [12, 24]
    with pytest.raises(ValueError):
        seed_phrase.seed_phrases(df, RULED[:-1])


def test_word_list_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("\n".join(RULED) + "\n\n")
    assert seed_phrase.word_list(spark, str(tmp_path / "words.txt")) == RULED
    (tmp_path / "more.txt").write_text("\n".join([*RULED, "extra"]))
    with pytest.raises(ValueError):
        seed_phrase.word_list(spark, str(tmp_path / "more.txt"))


def test_seed_phrase_tag_and_checksum():
    import hashlib
    import hmac

    digest = lambda words: hmac.new(b"Seed version", " ".join(words).encode(), hashlib.sha512).hexdigest()
    tagged = next(p for p in ([*RULED[k : k + 12]] for k in range(2000)) if digest(p).startswith(("01", "100", "101", "102")))
    index = {w: i for i, w in enumerate(RULED)}
    assert seed_words.phrases(" ".join(tagged), index) == [(0, 59, 12)]
    for n in (16, 20, 24, 28, 32):
        words = seed(bytes(range(n)))
        assert seed_words.checksum_holds(int("".join(f"{index[w]:011b}" for w in words), 2), len(words))
        assert list(seed_words.valid_windows(words, index))[0] == (0, len(words))
    began = __import__("time").process_time()
    seed_words.phrases(" ".join(RULED * 5), index)
    assert __import__("time").process_time() - began < 2


def test_seed_phrases_in_scans_and_redaction(spark):
    phrase = " ".join(seed(bytes(range(16))))
    df = strings(spark, [f"{AWS} and {phrase} end", phrase])
    found = scan(df, R.builtin_rules(), words=RULED)
    assert sorted((r.file, r.rule) for r in found.collect()) == [("f0", "aws-access-key"), ("f0", "bip39-mnemonic"), ("f1", "bip39-mnemonic")]
    done = redact.redact_column(df, "value", R.builtin_rules(), words=RULED).where("file = 'f0'").first()
    assert done.redacted == "[REDACTED:aws-access-key] and [REDACTED:bip39-mnemonic] end"
    assert scan(df, R.builtin_rules()).count() == 1


def test_columns_named_like_the_scan_s_own(spark):
    df = spark.createDataFrame([(1, 2, 3, "x", f"k {AWS}")], "end int, idx int, hit int, keys string, value string")
    assert [(r.idx, r.hit, r["keys"], r.match) for r in scan(df, R.builtin_rules()).drop("end").collect()] == [(2, 3, "x", AWS)]


def test_detector_plug_ins(spark):
    """A check-digit detector as a plug-in: its hits are rows like any other and meet the rules' hits in one fold."""
    from leaksieve.functions import detectors as D

    def luhn(digits):
        build = lambda: lambda text: [m.span() for m in re.finditer(rf"\b\d{{{digits}}}\b", text) if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(m[0][::-1])) % 10 == 0]
        return D.Detector("card-number", build)

    if "luhn" not in D.REGISTRY:
        D.register("luhn", luhn)
    with pytest.raises(ValueError):
        D.register("luhn", luhn)
    with pytest.raises(ValueError):
        D.detector("unknown")
    rules = R.with_pack(R.builtin_rules(), [R.Rule(0, "card-number", "Card number", "")])
    good, bad = "4111111111111111", "4111111111111112"
    found = scan(strings(spark, [f"{AWS} and {good}, {bad}", bad, f"id=AKIA{good}"]), rules, detectors=[D.detector("luhn", digits=16)])
    assert sorted((r.file, r.rule, r.match) for r in found.collect()) == [("f0", "aws-access-key", AWS), ("f0", "card-number", good), ("f2", "aws-access-key", f"AKIA{good}")]
    done = redact.redact_column(strings(spark, [f"n {good}"]), "value", rules, detectors=[D.detector("luhn", digits=16)]).first()
    assert done.redacted == "n [REDACTED:card-number]"
    assert scan(strings(spark, [good]), R.builtin_rules(), detectors=[D.detector("luhn", digits=16)]).count() == 0  # its rule isn't asked for
