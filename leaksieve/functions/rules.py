"""The rule table: patterns, anchors, gates and rotation texts; user packs in the same form."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _parser as parser  # the standard library's own syntax tree of patterns
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from leaksieve.functions.rule_data import DETECTOR, RULES

SEED_PHRASE = DETECTOR[0]
DEFAULT_ROTATION = "rotate via the issuing provider"


class Rule(NamedTuple):
    """order is the match priority; a text is tried if it holds one of the anchors (lower case) and the gate matches."""

    order: int
    rule: str
    display: str
    pattern: str
    anchors: tuple[str, ...] = ()
    gate: str | None = None
    rotation: str | None = None


#: Necessary conditions: the pattern without its borders, or the flag that must follow the command.
GATES = {
    "private-key-pem": r"-----END",
    "twilio": r"SK[0-9a-fA-F]{32}",
    "discord-bot-token": r"[MNO][\w-]{23,27}\.[\w-]{6,7}\.[\w-]{27,40}",
    "telegram-bot-token": r"\d{5,16}:A[A-Za-z0-9_-]{34}",
    "curl-auth-header": r"(?s)curl.{0,1242}?(?:-H|--header)",
    "curl-auth-user": r"(?s)curl.{0,1242}?(?:-u|--user)",
}
#: Alternatives that a literal may have, and the least length of one: shorter ones are in every text.
MOST_ALTERNATIVES, LEAST_LENGTH = 16, 2


def _better(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    """The set whose shortest literal is longer; of a tie the smaller set."""
    worth = lambda s: (min(map(len, s), default=0), -len(s))
    return max(a, b, key=worth)


def _choices(node) -> list[str] | None:
    """The texts that a node stands for, if they are few: a character, a small class, alternatives of plain texts."""
    kind, value = node
    if kind is parser.LITERAL:
        return [chr(value).lower()]
    if kind is parser.IN:
        return sorted({chr(v).lower() for k, v in value}) if len(value) <= 4 and all(k is parser.LITERAL for k, _ in value) else None
    if kind is parser.SUBPATTERN:
        return _plain(value[3])
    if kind is parser.BRANCH:
        texts = [_plain(branch) for branch in value[1]]
        return sorted({t for some in texts for t in some}) if all(t is not None for t in texts) else None
    return None


def _plain(nodes) -> list[str] | None:
    """All texts of a sequence of nodes, if they are few."""
    out = [""]
    for node in nodes:
        more = _choices(node)
        if more is None or len(out) * len(more) > MOST_ALTERNATIVES:
            return None
        out = [a + b for a in out for b in more]
    return out


def _necessary(nodes) -> frozenset[str]:
    """Lower-case texts of which any match of the nodes holds at least one; empty if none is known."""
    best: frozenset[str] = frozenset()
    run = [""]
    for node in [*nodes, (None, None)]:
        more = None if node[0] is None else _choices(node)
        if more is not None and len(run) * len(more) <= MOST_ALTERNATIVES:
            run = [a + b for a in run for b in more]
            continue
        if run != [""]:
            best = _better(best, frozenset(run))
        run = more or [""]
        kind, value = node
        if more is None and kind is parser.SUBPATTERN:
            best = _better(best, _necessary(value[3]))
        elif more is None and kind is parser.BRANCH:
            each = [_necessary(branch) for branch in value[1]]
            best = _better(best, frozenset().union(*each) if all(each) else frozenset())
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
            best = _better(best, _necessary(value[2]))
    return best


def anchors_of(pattern: str) -> tuple[str, ...]:
    """Literals (lower case) of which every match of the pattern holds one, read off its parse tree; none if they would be too short."""
    found = _necessary(parser.parse(pattern))
    return tuple(sorted(found)) if min(map(len, found), default=0) >= LEAST_LENGTH else ()


def builtin_rules() -> list[Rule]:
    """All rules in match priority, the seed-phrase detector (which has no pattern) last."""
    rules = [Rule(i, rule, display, pattern, anchors_of(pattern), GATES.get(rule), rotation) for i, (rule, display, pattern, rotation) in enumerate(RULES)]
    rule, display, rotation = DETECTOR
    return [*rules, Rule(len(rules), rule, display, "", (), None, rotation)]


def with_pack(rules: Iterable[Rule], pack: Iterable[Rule]) -> list[Rule]:
    """The rules followed by a user pack; a rule name may occur once."""
    rules, pack = list(rules), list(pack)
    if twice := {r.rule for r in rules} & {r.rule for r in pack}:
        raise ValueError(f"rules defined twice: {sorted(twice)}")
    first = max((r.order for r in rules), default=-1) + 1
    return rules + [r._replace(order=first + k) for k, r in enumerate(pack)]


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(r.order, r.rule, r.display, r.pattern, list(r.anchors), r.gate, r.rotation or DEFAULT_ROTATION) for r in rules]
    return spark.createDataFrame(rows, "rule_idx int, rule string, display string, pattern string, anchors array<string>, gate string, rotation string")


def select_rules(rules: Iterable[Rule], only: Iterable[str] = (), exclude: Iterable[str] = ()) -> set[str]:
    """Names that pass an only- or exclude-list; unknown names and giving both are errors."""
    names, only, exclude = {r.rule for r in rules}, set(only), set(exclude)
    if only and exclude:
        raise ValueError("only and exclude can't be combined")
    if unknown := (only | exclude) - names:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return only or names - exclude
