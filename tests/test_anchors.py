"""Anchors read off patterns: any match holds one of them."""

import re
import warnings

import pytest
from hypothesis import HealthCheck, given, seed, settings
from hypothesis import strategies as st
from hypothesis.errors import HypothesisWarning

from leaksieve.functions.rules import LEAST_LENGTH, anchors_of, builtin_rules


@pytest.mark.parametrize(
    "pattern,anchors",
    [
        (r"\bAKIA[0-9A-Z]{16}\b", ("akia",)),
        (r"(?:sk|rk)_live_\d+", ("rk_live_", "sk_live_")),
        (r"gh[su]_\w+", ("ghs_", "ghu_")),
        (r"(?i)[\w.-]{0,50}?(?:cohere|CO_API_KEY)x*", ("co_api_key", "cohere")),
        (r"(?:a|b)?\d+", ()),
        (r"x{0,3}abcd?e", ("abc",)),
        (r"(?:abc|\d+)z", ()),
        (r"(?:one\d|three\d)z", ("one", "three")),
        (r"(?:ab){2,}\d", ("ab",)),
        (r"(?=abc)\d", ()),
    ],
)
def test_known_patterns(pattern, anchors):
    assert anchors_of(pattern) == anchors


RULES = [r for r in builtin_rules() if r.anchors]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.rule)
def test_matches_hold_an_anchor(rule):
    assert min(map(len, rule.anchors)) >= LEAST_LENGTH
    seen = []
    bare = re.sub(r"\(\?[=!<][^()]*(?:\([^()]*\)[^()]*)*\)", "", rule.pattern)  # lookarounds only narrow a pattern; texts are drawn without them

    @seed(1)
    @settings(max_examples=12, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(bare))
    def run(text):
        for m in re.finditer(rule.pattern, text):
            seen.append(m[0])
            assert any(a in m[0].lower() for a in rule.anchors)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", HypothesisWarning)
        run()


def test_rules_in_match_order():
    rules = builtin_rules()
    assert [r.order for r in rules] == list(range(214)) and len({r.rule for r in rules}) == 214
    assert all(r.rotation and r.display for r in rules) and all(re.compile(r.pattern) for r in rules)
