"""End to end: read, scan, filter, suppress, report, redact."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leaksieve.functions.detectors import Detector
from leaksieve.functions.rules import Rule
from leaksieve.operators import budget, commit, redact, report, suppress
from leaksieve.operators.scan import scan
from leaksieve.operators.staging import staged
from leaksieve.sources.catalog import SOURCES


class Scan(NamedTuple):
    """findings keep the plaintext (match) for redaction; every sink takes report.records(findings). counters: what the first action on findings has scanned."""

    findings: DataFrame
    suppressed: DataFrame
    truncated: DataFrame
    counters: Observation


def scan_history(
    strings: DataFrame, rules: Sequence[Rule], ignores: DataFrame | None = None, only: Iterable[str] = (), exclude: Iterable[str] = (), file_budget: int | None = budget.FILE_BUDGET, words: Sequence[str] = (), detectors: Sequence[Detector] = ()
) -> Scan:
    """Budget, scan, rule filter, then suppression; suppressed is (source, suppressed) counts, truncated names cut files.

    words: the seed-phrase detector's word list; detectors: further ones. With ignore entries the marked findings are written once, for findings and counts alike.
    counters.get: strings and characters scanned, and empty strings, from the scan itself (no second pass).
    """
    counters = Observation()
    kept = budget.within_budget(strings, file_budget).observe(counters, F.count(F.lit(1)).alias("strings"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("characters"), F.count_if(F.coalesce("value", F.lit("")) == "").alias("empty"))
    found = suppress.only_rules(scan(kept, rules, words=words, detectors=detectors), rules, only, exclude)
    over = budget.truncated_files(strings, file_budget)
    if ignores is None:
        return Scan(found, found.where(F.lit(False)).groupBy("source").agg(F.count(F.lit(1)).alias("suppressed")), over, counters)
    marked = staged(suppress.with_suppression(found, ignores))
    counted = marked.where("suppressed").groupBy("source").agg(F.count(F.lit(1)).alias("suppressed"))
    return Scan(marked.where(~F.col("suppressed")).drop("suppressed"), counted, over, counters)


def write_reports(result: Scan, rules: Sequence[Rule], out: str, sources: Sequence[str] = SOURCES) -> None:
    """Records in order, a preview, statistics, exposure groups with their places, checklist, one JSON document and SARIF below one folder; none holds plaintext.

    The scan runs once, for the table of findings that the reports read.
    """
    table = result.findings.drop("match")
    table.write.mode("overwrite").json(f"{out}/table")
    findings = table.sparkSession.read.schema(table.schema).json(f"{out}/table")
    report.write_ordered(findings, f"{out}/findings", sources)
    report.preview(findings, sources).write.mode("overwrite").json(f"{out}/preview")
    report.exposed_places(findings).write.mode("overwrite").json(f"{out}/places")
    report.write_document(report.json_document(findings, rules, sources), f"{out}/document")
    report.stats(findings).write.mode("overwrite").json(f"{out}/stats")
    report.blast_radius(findings, rules).write.mode("overwrite").json(f"{out}/blast_radius")
    report.rotation_items(findings, rules).write.mode("overwrite").json(f"{out}/rotation")
    report.text_lines(findings).write.mode("overwrite").text(f"{out}/text")
    report.sarif(findings, rules).select("value").write.mode("overwrite").text(f"{out}/sarif")


def rewritten(kind: str, rows: DataFrame, findings: DataFrame, template: str = redact.TEMPLATE) -> DataFrame:
    """The lines of history files with their findings redacted (file, line, raw, changed, failed, was); nothing is written.

    kind: jsonl or text (rows: file, line, raw) or json (rows: file, text, one document each). findings say where (file, line, path, spans) and what was
    there, so only they are grouped and joined; a text that is no longer what was scanned fails its file.
    """
    edits = redact.edits_of(findings, template)
    return {"jsonl": redact.redact_json_lines, "json": redact.redact_json_files, "text": redact.redact_text_lines}[kind](rows, edits)


def redact_files(kind: str, rows: DataFrame, findings: DataFrame, target: str, run_id: str, template: str = redact.TEMPLATE) -> DataFrame:
    """Redact, validate and commit below target: files that pass are written with vault and audit, others are only named. Returns the statuses."""
    return commit.commit(rewritten(kind, rows, findings, template), target, run_id, kind)


def redact_jsonl(lines: DataFrame, findings: DataFrame, template: str = redact.TEMPLATE) -> tuple[DataFrame, DataFrame]:
    """(rewritten lines, statuses) of JSONL files: lines is (file, line, raw), findings have path. Files that fail keep their lines."""
    new = staged(rewritten("jsonl", lines, findings, template))
    statuses = commit.file_statuses(new, "jsonl")
    ok = statuses.where(F.col("status") == "ok").select("file", F.lit(True).alias("_ok"))
    kept = F.when(F.coalesce("_ok", F.lit(False)), F.col("raw")).otherwise(F.coalesce("was", "raw"))
    return new.join(ok, "file", "left").select("file", "line", kept.alias("raw")), statuses


def redact_table(table: DataFrame, keys: Sequence[str], columns: Sequence[str], rules: Sequence[Rule], run_id: str, template: str = redact.TEMPLATE, words: Sequence[str] = (), detectors: Sequence[Detector] = ()) -> tuple[DataFrame, DataFrame]:
    """(new version of the table, vault rows) with the named string columns redacted in one pass each."""
    out, vaults = table, []
    for c in columns:
        done = redact.redact_column(out, c, rules, template, name="_new", words=words, count="_n_new", detectors=detectors)
        vaults.append(redact.vault_rows(done, list(keys), c, "_new", run_id).select("run_id", *keys, F.lit(c).alias("column"), "original"))
        out = done.withColumn(c, F.col("_new")).drop("_new", "_n_new")
    vault = vaults[0]
    for v in vaults[1:]:
        vault = vault.unionByName(v)
    return out, vault
