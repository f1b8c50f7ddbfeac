"""Reports over findings: records, statistics, exposure groups, rotation checklist, text lines, SARIF, comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.functions.rules import Rule
from leaksieve.functions.text import file_uri, fingerprint
from leaksieve.operators.scan import with_rotation
from leaksieve.operators.staging import staged

#: The fields of a published finding; the plaintext is not among them.
PREVIEW = 40  # fixed value: rows of a preview
RECORD = ("file", "relpath", "line", "keypath", "rule", "display", "masked", "fingerprint")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(F.col("relpath"), F.col("line"), F.col("rule")))


def records(findings: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """What may be written: no plaintext. also: further columns of the findings."""
    have = with_fingerprint(findings)
    return have.select(*(c for c in ("source", *RECORD) if c in have.columns), *also)


def stats(findings: DataFrame) -> DataFrame:
    """scope (total, rule, source), name, findings: grouping sets in one pass."""
    g = findings.groupingSets([[], ["rule"], ["source"]], "rule", "source").agg(F.count(F.lit(1)).alias("findings"), F.grouping_id().alias("g"))
    scope = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "rule").otherwise("source")
    return g.select(scope.alias("scope"), F.coalesce(F.when(F.col("g") == 1, F.col("rule")).when(F.col("g") == 2, F.col("source")), F.lit("")).alias("name"), "findings")


def stats_document(findings: DataFrame) -> DataFrame:
    """One row: the statistics as a JSON document with sorted keys."""
    s = stats(findings)
    pick = lambda scope: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("scope") == scope, F.struct("name", "findings")))))
    doc = s.agg(F.coalesce(F.max(F.when(F.col("scope") == "total", F.col("findings"))), F.lit(0)).alias("total_findings"), pick("rule").alias("by_rule"), pick("source").alias("by_source"))
    return doc.select(F.to_json(F.struct("total_findings", "by_rule", "by_source")).alias("value"))


def blast_radius(findings: DataFrame, rules: Sequence[Rule], places: bool = False) -> DataFrame:
    """source, masked, rule, display, occurrences, files and rotation of each exposed value. Its places are rows of exposed_places.

    Groups are by masked text within a source; rule and display are those of the first place. Occurrences of one file meet first, so a value
    that is everywhere is counted in parts. places: also an array of all its files by name, each with its number of occurrences (n).
    """
    place = F.struct("file", "line", "start", "rule_idx")
    by_file = findings.groupBy("source", "masked", "file").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(place.alias("at"), "rule", "display")).alias("first"))
    listed = [F.array_sort(F.collect_list(F.struct("file", "n"))).alias("places")] if places else []
    grouped = by_file.groupBy("source", "masked").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files"), F.min("first").alias("first"), *listed)
    return with_rotation(grouped.select("source", "masked", "first.rule", "first.display", "occurrences", "files", *(["places"] if places else [])), rules)


def exposed_places(findings: DataFrame) -> DataFrame:
    """source, masked, file, line, times: where each exposed value was found, a row a line."""
    return findings.groupBy("source", "masked", "file", "line").agg(F.count(F.lit(1)).alias("times"))


def _ordered_keys(findings: DataFrame, sources: Sequence[str]) -> list[Column]:
    """Sort keys of findings: the sources' order (others last, by name), then file, place and rule."""
    known = F.array_position(F.array(*map(F.lit, sources)), F.col("source")) if sources else F.lit(0)
    return [F.when(known == 0, len(sources) + 1).otherwise(known), F.col("source"), F.col("file"), F.col("line"), *([F.col("seq")] if "seq" in findings.columns else []), F.col("start"), F.col("rule_idx")]


def ordered(findings: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """findings in source order, then by file, line and start, with position (from 1) over all of them; written once, in order.

    One exchange by ranges of the whole key, so a hot source or file spans many tasks. A task numbers its rows; the tasks' sizes, one
    small row each, are summed up to their offsets.
    """
    keys = [k.alias(f"_o{i}") for i, k in enumerate(_ordered_keys(findings, sources))]
    names = [f"_o{i}" for i in range(len(keys))]
    return _positions(findings.select("*", *keys), names).select(*findings.columns, "position")


def write_ordered(findings: DataFrame, path: str, sources: Sequence[str] = ()) -> None:
    """The records as JSON lines in files whose names sort as the records do."""
    numbered = with_fingerprint(ordered(findings, sources))
    cut = numbered.select("position", *(c for c in ("source", *RECORD) if c in numbered.columns))
    cut.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").json(path)


def preview(findings: DataFrame, sources: Sequence[str] = (), rows: int = PREVIEW) -> DataFrame:
    """The first rows of the ordered records with more: how many findings lie beyond them. A partial top-k in each task, no sort of all."""
    keys = _ordered_keys(findings, sources)
    top = with_fingerprint(findings).orderBy(*keys).limit(rows)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*keys)))  # at most `rows` rows
    total = findings.agg(F.count(F.lit(1)).alias("_n"))
    return numbered.crossJoin(total).select("position", *(c for c in ("source", *RECORD) if c in numbered.columns), F.greatest(F.col("_n") - rows, F.lit(0)).alias("more"))


def json_document(findings: DataFrame, rules: Sequence[Rule], sources: Sequence[str] = ()) -> DataFrame:
    """section, position, value: the lines of one JSON document with findings, blast_radius, places and stats, in order.

    The document is a table of lines (write_document), since it has no bound; no line holds more than one record.
    """
    numbered = ordered(findings, sources)
    shown = with_fingerprint(numbered)
    rows = shown.select(F.lit(1).alias("section"), "position", F.to_json(F.struct(*(c for c in ("source", *RECORD) if c in shown.columns))).alias("record"))

    def section(df: DataFrame, number: int, *order: str) -> DataFrame:
        named = df.select(F.to_json(F.struct(*df.columns)).alias("record"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(order)), F.lit(number).alias("section"))
        return _positions(named, [f"_k{i}" for i in range(len(order))]).select("section", "position", "record")

    groups = section(blast_radius(findings, rules), 2, "source", "masked")
    places = section(exposed_places(findings), 3, "source", "masked", "file", "line")
    lines = reduce(DataFrame.unionByName, (rows, groups, places)).select("section", "position", F.concat(F.when(F.col("position") > 1, ",").otherwise(""), "record").alias("value"))
    fixed = [(1, 0, '{"findings":['), (2, 0, '],"blast_radius":['), (3, 0, '],"places":['), (4, 0, '],"stats":')]
    frame = findings.sparkSession.createDataFrame([*fixed, (5, 0, "}")], "section int, position long, value string")
    stats_line = stats_document(findings).select(F.lit(4).alias("section"), F.lit(1).cast("long").alias("position"), "value")
    return frame.unionByName(lines).unionByName(stats_line)


def _positions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with position (from 1) in the order of the named columns."""
    row = F.monotonically_increasing_id()
    placed = staged(df.repartitionByRange(*names).sortWithinPartitions(*names).select("*", F.shiftright(row, 33).alias("_part"), row.bitwiseAND((1 << 33) - 1).alias("_row")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_before"))
    return placed.join(starts, "_part").select(*df.columns, (F.col("_before") + F.col("_row") + 1).alias("position"))


def write_document(document: DataFrame, path: str) -> None:
    """The document's lines as text files; put together in the order of their names they are the document."""
    document.repartitionByRange("section", "position").sortWithinPartitions("section", "position").select("value").write.mode("overwrite").text(path)


def rotation_items(findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, display, rotation of each rule that was found."""
    return with_rotation(findings.select("rule", "display").distinct(), rules).select("rule", "display", "rotation")


def per_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("source", "file").agg(F.count(F.lit(1)).alias("findings"))


def first_seen(findings: DataFrame) -> DataFrame:
    """rule, rule_index: rules numbered from 0 in the order of their first finding (by file, line, start)."""
    firsts = findings.groupBy("rule").agg(F.min(F.struct("file", "line", "start", "rule_idx")).alias("at"))
    return firsts.select("rule", (F.dense_rank().over(Window.orderBy("at")) - 1).alias("rule_index"))  # as many rows as rules


def text_lines(findings: DataFrame) -> DataFrame:
    """value: fingerprint, display and masked text per finding."""
    return with_fingerprint(findings).select(F.format_string("%s  %s  %s", "fingerprint", "display", "masked").alias("value"))


def finding_set_hash(findings: DataFrame) -> DataFrame:
    """n, digest: equal for equal multisets of findings whatever their order (a sum, so it needs no sort)."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "file", "line", "rule")]
    row = F.conv(F.substring(F.md5(F.concat_ws(":", *fields, F.sha2("match", 256)).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return findings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def compare(before: DataFrame, now: DataFrame) -> DataFrame:
    """source, fingerprint, masked texts and state (same, changed, new, gone) of findings in two scans."""
    fold = lambda df, c: with_fingerprint(df).groupBy("source", "fingerprint").agg(F.array_sort(F.collect_set("masked")).alias(c))
    both = fold(before, "before").join(fold(now, "now"), ["source", "fingerprint"], "full_outer")
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("before") == F.col("now"), "same").otherwise("changed")
    return both.select("source", "fingerprint", "before", "now", state.alias("state"))


SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


#: Results of a SARIF document.
RESULTS = 5_000


def _sarif_parts(findings: DataFrame, rules: Sequence[Rule], tool: str) -> tuple[DataFrame, DataFrame]:
    """(source, driver: the tool with the source's rules, numbered by first appearance) and (source, file, line, start, rule_idx, result)."""
    rows = with_fingerprint(findings)
    firsts = rows.groupBy("source", "rule", "display").agg(F.min(F.struct("file", "line", "start", "rule_idx")).alias("at"))
    numbered = with_rotation(firsts, rules).withColumn("ruleIndex", F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1)
    text = lambda c: F.struct(c.alias("text"))
    descriptor = F.struct(F.col("rule").alias("id"), text(F.col("display")).alias("shortDescription"), text(F.col("rotation")).alias("help"))
    described = numbered.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("ruleIndex", descriptor.alias("d")))), lambda x: x["d"]).alias("rules"))
    location = F.struct(F.struct(F.struct(file_uri(F.col("file")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule").alias("ruleId"),
        "ruleIndex",
        F.lit("error").alias("level"),
        text(F.concat(F.col("display"), F.lit(": "), F.col("masked"))).alias("message"),
        F.array(location).alias("locations"),
        F.struct(F.col("fingerprint").alias("leaksieve/v1")).alias("partialFingerprints"),
    )
    placed = rows.join(numbered.select("source", "rule", "ruleIndex"), ["source", "rule"])
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver"))
    return described.select("source", driver.alias("driver")), placed.select("source", "file", "line", "start", "rule_idx", result.alias("result"))


def sarif(findings: DataFrame, rules: Sequence[Rule], tool: str = "leaksieve", results: int = RESULTS) -> DataFrame:
    """SARIF 2.1.0 documents of about so many results each (source, part, value); rules are the source's, numbered by first appearance.

    A source's results are dealt to its parts by a hash of their file, line and place, so a hot source is many rows.
    """
    described, placed = _sarif_parts(findings, rules, tool)
    parts = findings.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / results).alias("parts"))
    dealt = placed.join(parts, "source").withColumn("part", F.pmod(F.xxhash64("file", "line", "start"), "parts").cast("int"))
    listed = dealt.groupBy("source", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "start", F.col("result").alias("r")))), lambda x: x["r"]).alias("results"))
    doc = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(F.col("driver").alias("tool"), "results")).alias("runs"))
    return described.join(listed, "source").select("source", "part", F.to_json(doc).alias("value"))


#: Results whose texts are put together at once.
PIECE = 1_000


def sarif_by_source(findings: DataFrame, rules: Sequence[Rule], tool: str = "leaksieve", piece: int = PIECE) -> DataFrame:
    """One SARIF 2.1.0 document for each source, however many results it has (source, part: 0, value); sarif deals a hot source to several.

    Results are spelled where they lie, numbered over a range exchange and put together in pieces; the group of a source only joins its pieces.
    """
    described, placed = _sarif_parts(findings, rules, tool)
    order = ["source", "file", "line", "start", "rule_idx"]
    spelled = _positions(placed.select(*order, F.to_json("result").alias("text")), order)
    joined = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]), ",").alias("text")
    pieces = spelled.groupBy("source", F.floor(F.col("position") / piece).alias("piece")).agg(joined("position"))
    whole = pieces.groupBy("source").agg(joined("piece"))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":'
    value = F.concat(F.lit(head), F.to_json("driver"), F.lit(',"results":['), "text", F.lit("]}]}"))
    return described.join(whole, "source").select("source", F.lit(0).alias("part"), value.alias("value"))
