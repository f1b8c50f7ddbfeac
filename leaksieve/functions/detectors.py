"""Detectors: functions that find credentials no pattern can express. Their hits enter the same overlap fold as those of the rules.

A detector names the rule its hits count for, and builds its finder once in each worker: a function from a text to the (start, end)
of each hit, in code points. Detectors are registered by name, as factories that take parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from leaksieve.functions.rule_data import DETECTOR
from leaksieve.functions.seed_words import phrases

SEED_PHRASE = DETECTOR[0]
Finder = Callable[[str], Iterable[tuple[int, int]]]


class Detector(NamedTuple):
    rule: str
    build: Callable[[], Finder]


REGISTRY: dict[str, Callable[..., Detector]] = {}


def register(name: str, factory: Callable[..., Detector]) -> None:
    """Make a detector known by name; a name is taken once."""
    if name in REGISTRY:
        raise ValueError(f"a detector named {name} exists")
    REGISTRY[name] = factory


def detector(name: str, **parameters) -> Detector:
    if name not in REGISTRY:
        raise ValueError(f"no detector is named {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**parameters)


def seed_phrase(words: Sequence[str]) -> Detector:
    """Wallet seed phrases of a word list: the 2048 words of a standard list in its order (a parameter, such as the lines of its file)."""
    words = tuple(w.strip() for w in words)
    if len(words) != 2048 or len(set(words)) != 2048:
        raise ValueError("a word list has 2048 different words")

    def build() -> Finder:
        index = {w: i for i, w in enumerate(words)}
        return lambda text: [(start, end) for start, end, _ in phrases(text, index)]

    return Detector(SEED_PHRASE, build)


register(SEED_PHRASE, seed_phrase)


def detectors_of(words: Sequence[str] = (), more: Iterable[Detector] = ()) -> tuple[Detector, ...]:
    """The seed-phrase detector, if there is a word list, and further ones."""
    return (*((detector(SEED_PHRASE, words=words),) if words else ()), *more)
