"""The scan: which rules match where in each string. One narrow projection, no shuffle.

An Arrow function holds the compiled patterns of a rule set, once per worker. One pass of an automaton over the lower-case
text finds the anchors; a rule is tried only where one of its anchors (and its gate, if it has one) is found, by Python's
re, whose classes and borders define what a match is. Overlaps are folded in the row by built-in expressions.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.detectors import SEED_PHRASE, Detector, detectors_of
from leaksieve.functions.rules import DEFAULT_ROTATION, Rule, rules_table
from leaksieve.functions.slices import by_slices
from leaksieve.functions.text import masked

HIT = "struct<start:int,idx:int,end:int,value:string>"
_ARROW_HIT = pa.struct([("start", pa.int32()), ("idx", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
#: (start, rule index, end) of each hit in a text.
Spans = Callable[[str], list[tuple[int, int, int]]]


def anchor_finder(anchors: Sequence[str]) -> Callable[[str], set[str]]:
    """The anchors that a lower-case text holds."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {a for a in anchors if a in text}
    machine = ahocorasick.Automaton()
    for a in anchors:
        machine.add_word(a, a)
    machine.make_automaton()
    return lambda text: {a for _, a in machine.iter(text)}


@functools.lru_cache(maxsize=8)
def pattern_finder(rules: tuple[Rule, ...]) -> Spans:
    """All matches of the rules' patterns in a text."""
    patterns = {r.order: re.compile(r.pattern) for r in rules if r.pattern}
    gates = {r.order: re.compile(r.gate) for r in rules if r.gate}
    always = [r.order for r in rules if r.pattern and not r.anchors]
    by_anchor: dict[str, list[int]] = {}
    for r in rules:
        for a in r.anchors if r.pattern else ():
            by_anchor.setdefault(a, []).append(r.order)
    find = anchor_finder(list(by_anchor)) if by_anchor else lambda text: set()

    def spans(text: str) -> list[tuple[int, int, int]]:
        tried = sorted({k for a in find(text.lower()) for k in by_anchor[a]}.union(always))
        return [(m.start(), k, m.end()) for k in tried if k not in gates or gates[k].search(text) for m in patterns[k].finditer(text)]

    return spans


def span_finder(rules: tuple[Rule, ...], detectors: tuple[Detector, ...] = ()) -> Spans:
    """All hits of the rules and detectors in a text."""
    matches = pattern_finder(rules)
    order = {r.rule: r.order for r in rules}
    more = [(order[d.rule], d.build()) for d in detectors if d.rule in order]  # a rule that isn't among the rules is not asked for
    if not more:
        return matches
    return lambda text: matches(text) + [(start, k, end) for k, find in more for start, end in find(text)]


def _finder(rules: Sequence[Rule], detectors: Sequence[Detector]):
    rules, detectors = tuple(rules), tuple(detectors)
    built: list[Spans] = []  # filled once in each worker

    def finder() -> Spans:
        if not built:
            built.append(span_finder(rules, detectors))
        return built[0]

    def some(values: pa.Array) -> pa.Array:
        spans = finder()
        offsets, starts, which, ends, found = [0], [], [], [], []
        for text in values.to_pylist():
            for start, k, end in spans(text) if text else ():
                starts.append(start)
                which.append(k)
                ends.append(end)
                found.append(text[start:end])
            offsets.append(len(starts))
        columns = [pa.array(x, pa.int32()) for x in (starts, which, ends)] + [pa.array(found, pa.string())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_ARROW_HIT)))

    @F.arrow_udf(f"array<{HIT}>")
    def run(values: pa.Array) -> pa.Array:
        return by_slices(some, pa.list_(_ARROW_HIT), values)

    return run


def without_overlaps(hits: Column) -> Column:
    """Left fold over hits by (start, rule): one that begins inside the last kept hit replaces it only if longer."""
    empty = F.array().cast(f"array<{HIT}>")

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        apart = (F.size(kept) == 0) | (x["start"] >= last["end"])
        longer = x["end"] - x["start"] > last["end"] - last["start"]
        return F.when(apart, F.array_append(kept, x)).when(longer, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), x)).otherwise(kept)

    return F.when(F.size(hits) < 2, hits).otherwise(F.aggregate(F.array_sort(hits), empty, step))


def folded(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same fold over (start, rule index, end) in Python, for functions that rewrite a text where they scan it."""
    kept: list[tuple[int, int, int]] = []
    for hit in sorted(hits):
        if not kept or hit[0] >= kept[-1][2]:
            kept.append(hit)
        elif hit[2] - hit[0] > kept[-1][2] - kept[-1][0]:
            kept[-1] = hit
    return kept


def with_hits(df: DataFrame, column: str, rules: Sequence[Rule], name: str = "hits", words: Sequence[str] = (), cap: int | None = None, detectors: Sequence[Detector] = ()) -> DataFrame:
    """df with an array of (start, idx, end, value), overlaps resolved, for a string column; empty for null.

    words: the word list of the seed-phrase detector; without one it doesn't run. detectors: further ones. cap: a string is scanned up
    to this many code points (None: all of it).
    """
    value = F.col(column) if cap is None else F.substring(column, 1, cap)
    return df.withColumn(name, _finder(rules, detectors_of(words, detectors))(value)).withColumn(name, without_overlaps(F.col(name)))


def scan(strings: DataFrame, rules: Sequence[Rule], value: str = "value", words: Sequence[str] = (), detectors: Sequence[Detector] = ()) -> DataFrame:
    """Findings: the other columns of strings with rule_idx, rule, display, match, masked, start and end (code points).

    match is the plaintext; sinks drop it. A seed phrase is masked to its first and last word. Columns of strings may have any
    names but these.
    """
    keys = [c for c in strings.columns if c != value]
    held = strings.select(F.struct(*keys).alias("keys"), F.col(value).alias("text"))
    # an outer generator: the optimiser would copy the whole scan into a filter in front of an inner one
    hits = with_hits(held, "text", rules, "hits", words, detectors=detectors).select("keys", F.explode_outer("hits").alias("hit")).where(F.col("hit").isNotNull())
    named = F.broadcast(rules_table(strings.sparkSession, rules).select("rule_idx", "rule", "display"))
    match = F.col("hit.value")
    ends = F.concat(F.lower(F.regexp_extract(match, r"\A[A-Za-z]+", 0)), F.lit(" …["), F.regexp_count(match, F.lit("[A-Za-z]+")).cast("string"), F.lit(" words]… "), F.lower(F.regexp_extract(match, r"[A-Za-z]+\z", 0)))
    shown = F.when(F.col("rule") == SEED_PHRASE, ends).otherwise(masked(match))
    found = hits.join(named, F.col("hit.idx") == F.col("rule_idx"))
    return found.select("keys.*", "rule_idx", "rule", "display", match.alias("match"), shown.alias("masked"), F.col("hit.start").alias("start"), F.col("hit.end").alias("end"))


def with_rotation(findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """findings with the rule's rotation text."""
    table = F.broadcast(rules_table(findings.sparkSession, rules).select("rule", "rotation"))
    return findings.join(table, "rule", "left").withColumn("rotation", F.coalesce("rotation", F.lit(DEFAULT_ROTATION)))


def prefilter_pairs(strings: DataFrame, rules: Sequence[Rule], value: str = "value") -> DataFrame:
    """(keys, rule): the rules each string is tried against by its anchors (a broadcast theta join, as a report)."""
    anchors = rules_table(strings.sparkSession, rules).select("rule", F.explode("anchors").alias("anchor"))
    keys = [c for c in strings.columns if c != value]
    return strings.join(F.broadcast(anchors), F.contains(F.lower(value), F.col("anchor"))).select(*keys, "rule").distinct()
