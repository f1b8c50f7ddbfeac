"""Redaction: findings become replaced texts, written only if valid, with a vault to restore from and an audit.

A string's new text is a fold over its hits in the row, so redacting a column is a projection. JSON lines and whole JSON files
are rewritten by splicing at key paths in an Arrow function; every other byte stays as it is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leaksieve.functions.detectors import Detector, detectors_of
from leaksieve.functions.json_splice import Refused, edited, respelled, spliced
from leaksieve.functions.rules import Rule
from leaksieve.functions.slices import by_slices
from leaksieve.functions.text import check_template, line_end, without_end
from leaksieve.operators.scan import folded, span_finder, with_hits

TEMPLATE = "[REDACTED:{rule}]"


def replaced(value: Column, hits: Column, names: Column, template: str) -> Column:
    """The text with each hit's span replaced by the template for its rule. names: map from rule index to rule."""
    check_template(template)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(done: Column, h: Column) -> Column:
        between = F.substring(value, done["at"] + 1, h["start"] - done["at"])
        new = F.replace(F.lit(template), F.lit("{rule}"), F.element_at(names, h["idx"]))
        return F.struct(h["end"].alias("at"), F.concat(done["text"], between, new).alias("text"))

    whole = F.aggregate(hits, start, step, lambda done: F.concat(done["text"], F.substring(value, done["at"] + 1, F.length(value))))
    return F.when(F.size(hits) > 0, whole).otherwise(value)


def _free(name: str, columns: Sequence[str]) -> str:
    """A column name that isn't taken."""
    while name in columns:
        name = "_" + name
    return name


def redact_column(df: DataFrame, column: str, rules: Sequence[Rule], template: str = TEMPLATE, only: Sequence[str] = (), name: str = "redacted", words: Sequence[str] = (), count: str = "n_redacted", detectors: Sequence[Detector] = ()) -> DataFrame:
    """df with a column of redacted texts (name) and of the number of redactions (count); null stays null. only: names of the rules that are applied.

    Columns of df are never overwritten: a name that is taken is an error.
    """
    if taken := {name, count} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist already: choose other names")
    hits = _free("_hits", df.columns)
    names = F.create_map(*(x for r in rules for x in (F.lit(r.order), F.lit(r.rule))))
    chosen = [r.order for r in rules if not only or r.rule in only]
    found = with_hits(df, column, rules, hits, words, detectors=detectors)
    if only:
        found = found.withColumn(hits, F.filter(hits, lambda h: h["idx"].isin(*chosen)))
    return found.withColumns({name: F.when(F.col(column).isNotNull(), replaced(F.col(column), F.col(hits), names, template)), count: F.size(hits).cast("long")}).drop(hits)


_RESPELLED = pa.struct([("text", pa.string()), ("n", pa.int64()), ("failed", pa.bool_())])


def redact_json_column(
    df: DataFrame, column: str, rules: Sequence[Rule], template: str = TEMPLATE, only: Sequence[str] = (), name: str = "redacted", count: str = "n_redacted", failed: str = "failed", words: Sequence[str] = (), detectors: Sequence[Detector] = ()
) -> DataFrame:
    """df with JSON texts whose strings are scanned and rewritten where they stand, the number of redactions, and whether a text is no JSON (it stays as it is).

    One projection without a shuffle, as redact_column; for findings that pass through ignore entries first there is redact_json_lines.
    """
    check_template(template)
    if taken := {name, count, failed} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist already: choose other names")
    rules, found_by = tuple(rules), detectors_of(words, detectors)
    text_for = {r.order: template.replace("{rule}", r.rule) for r in rules if not only or r.rule in only}
    built: list = []  # filled once in each worker

    def some(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(span_finder(rules, found_by))
        out = []
        for text in texts.to_pylist():
            hits_seen = 0

            def change(value: str) -> str | None:
                nonlocal hits_seen
                hits = [h for h in folded(built[0](value)) if h[1] in text_for]
                if not hits:
                    return None
                hits_seen += len(hits)
                ends = [0, *(end for _, _, end in hits)]
                starts = [*(start for start, _, _ in hits), len(value)]
                between = [value[a:b] for a, b in zip(ends, starts, strict=True)]
                return "".join(x for pair in zip(between, [*(text_for[k] for _, k, _ in hits), ""], strict=True) for x in pair)

            try:
                out.append({"text": None if text is None else respelled(text, change)[0], "n": hits_seen, "failed": False})
            except Refused:
                out.append({"text": text, "n": 0, "failed": True})
        return pa.array(out, _RESPELLED)

    @F.arrow_udf("struct<text:string,n:bigint,failed:boolean>")
    def respell(texts: pa.Array) -> pa.Array:
        return by_slices(some, _RESPELLED, texts)

    held = _free("_respelled", df.columns)
    done = df.withColumn(held, respell(F.col(column)))
    return done.withColumns({name: F.col(held)["text"], count: F.col(held)["n"], failed: F.col(held)["failed"]}).drop(held)


def redactions(findings: DataFrame, strings: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(file, line, keypath, path, new_value) for each string with findings: all of its spans in one rewrite.

    Strings are told apart by path where both sides have it (it tells list places from keys that are digits), else by keypath.
    """
    check_template(template)
    exact = "path" in findings.columns and "path" in strings.columns
    keys = ["file", "line", "path" if exact else "keypath"]
    more = [c for c in ("keypath", "path") if c in strings.columns and c not in keys]
    spans = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", F.col("rule_idx").alias("idx"), "end", F.col("match").alias("value")))).alias("hits"), F.map_from_entries(F.collect_set(F.struct("rule_idx", "rule"))).alias("names"))
    return strings.select(*keys, *more, "value").join(spans, keys).select(*keys, *more, replaced(F.col("value"), F.col("hits"), F.col("names"), template).alias("new_value"))


_TODO = "array<struct<path:string,new_value:string,edits:array<struct<start:int,end:int,was:string,text:string>>>>"


def edits_of(findings: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(file, line, path or keypath, edits) of each string with findings: its spans with what they hold and what replaces it.

    Findings alone say all of it: the texts they were found in are not joined again, and a text that has changed since is refused.
    """
    check_template(template)
    new = F.replace(F.lit(template), F.lit("{rule}"), F.col("rule"))
    key = "path" if "path" in findings.columns else "keypath"
    return findings.groupBy("file", "line", key).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("match").alias("was"), new.alias("text")))).alias("edits"))


def _changes(changes: DataFrame, *keys: str) -> DataFrame:
    """todo: the changes of each text, by new_value or by edits."""
    value = F.col("new_value") if "new_value" in changes.columns else F.lit(None).cast("string")
    edits = F.col("edits") if "edits" in changes.columns else F.lit(None).cast("array<struct<start:int,end:int,was:string,text:string>>")
    path = F.col("path") if "path" in changes.columns else F.lit(None).cast("string")
    return changes.groupBy(*keys).agg(F.collect_list(F.struct(path.alias("path"), value.alias("new_value"), edits.alias("edits"))).cast(_TODO).alias("todo"))


def _change(change: dict):
    return change["new_value"] if change["edits"] is None else partial(edited, edits=change["edits"])


def _spliced(documents: pa.Array, changes: pa.Array) -> pa.Array:
    out = []
    for text, todo in zip(documents.to_pylist(), changes.to_pylist(), strict=True):
        new: dict = {}
        try:
            for change in todo if text is not None else ():
                path = tuple(json.loads(change["path"]))
                if path in new and (change["new_value"] is None or new[path] != change["new_value"]):
                    raise Refused("two changes of one path")
                new[path] = _change(change)
            out.append(spliced(text, new) if text is not None else None)
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


def _edited_lines(lines: pa.Array, changes: pa.Array) -> pa.Array:
    out = []
    for text, todo in zip(lines.to_pylist(), changes.to_pylist(), strict=True):
        try:
            made = {c if isinstance(c := _change(change), str) else c(text) for change in todo} if text is not None else {None}
            out.append(made.pop() if len(made) == 1 else None)
        except Refused:
            out.append(None)
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def set_at(documents: pa.Array, changes: pa.Array) -> pa.Array:
    """A JSON text with strings replaced at key paths (JSON arrays of keys), every other byte kept; null where it is refused."""
    return by_slices(_spliced, pa.string(), documents, changes)


@F.arrow_udf(StringType())
def set_line(lines: pa.Array, changes: pa.Array) -> pa.Array:
    """A line with its spans replaced; null where that is refused, or where two changes give different lines."""
    return by_slices(_edited_lines, pa.string(), lines, changes)


def _rewritten(rows: DataFrame, new: Column) -> DataFrame:
    """file, line, raw, changed, failed and was (the text before, where it changed) of rows (file, line, raw, todo)."""
    done = rows.withColumn("_new", new)
    touched = F.col("todo").isNotNull()
    worked = touched & F.col("_new").isNotNull()
    changed = worked & (F.col("_new") != F.col("raw"))
    return done.select("file", "line", F.when(worked, F.col("_new")).otherwise(F.col("raw")).alias("raw"), changed.alias("changed"), (touched & F.col("_new").isNull()).alias("failed"), F.when(changed, F.col("raw")).alias("was"))


def redact_json_lines(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """lines (file, line, raw with its end) and changes (file, line, path, edits or new_value) -> lines with raw rewritten where changed, failed and was.

    Only the changed strings' bytes differ. A line whose change can't be applied stays as it was and is marked failed: the file must not be written.
    """
    joined = lines.select("file", "line", "raw").join(_changes(changes, "file", "line"), ["file", "line"], "left")
    body = F.when(F.col("todo").isNotNull(), without_end(F.col("raw")))
    return _rewritten(joined, F.concat(set_at(body, F.coalesce("todo", F.array().cast(_TODO))), line_end(F.col("raw"))))


def redact_json_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (file, text: one JSON document) and changes (file, path, edits or new_value), as redact_json_lines; each file is its line 1."""
    joined = files.select("file", F.lit(1).cast("long").alias("line"), F.col("text").alias("raw")).join(_changes(changes, "file"), "file", "left")
    body = F.when(F.col("todo").isNotNull(), F.col("raw"))
    return _rewritten(joined, set_at(body, F.coalesce("todo", F.array().cast(_TODO))))


def redact_text_lines(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """As redact_json_lines, for plain text: changes are (file, line, edits or new_value). Two different results for one line fail it, as does one with a line break."""
    joined = lines.select("file", "line", "raw").join(_changes(changes, "file", "line"), ["file", "line"], "left")
    body = F.when(F.col("todo").isNotNull(), without_end(F.col("raw")))
    new = joined.withColumn("_line", set_line(body, F.coalesce("todo", F.array().cast(_TODO))))
    return _rewritten(new, F.when(~F.col("_line").rlike(r"[\r\n]"), F.concat("_line", line_end(F.col("raw")))))


def vault_rows(changed: DataFrame, keys: Sequence[str], original: str, redacted: str, run_id: str) -> DataFrame:
    """run_id, keys and the original of every row whose text changed: what restore needs."""
    return changed.where(~F.col(original).eqNullSafe(F.col(redacted))).select(F.lit(run_id).alias("run_id"), *keys, F.col(original).alias("original"))


def restore(table: DataFrame, vault: DataFrame, keys: Sequence[str], column: str, run_id: str) -> DataFrame:
    """The table with the originals of a run put back."""
    mine = vault.where(F.col("run_id") == run_id).select(*keys, "original")
    return table.join(mine, list(keys), "left").withColumn(column, F.coalesce("original", column)).drop("original")


def purge(vault: DataFrame, run_id: str) -> DataFrame:
    """The vault without a run (written over, or dropped as a partition)."""
    return vault.where(F.col("run_id") != run_id)


def unpurged(vault: DataFrame) -> DataFrame:
    """run_id, originals: runs whose plaintext is still kept."""
    return vault.groupBy("run_id").agg(F.count(F.lit(1)).alias("originals"))
