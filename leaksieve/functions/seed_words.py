"""Wallet seed phrases in one text: runs of word-list words whose checksum or version tag holds."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator, Mapping

#: Lengths tried (longest first), the most characters between words, the least separators, the version tags.
LENGTHS = (24, 21, 18, 15, 12)
_WORD = re.compile(r"[a-zA-Z]{3,8}")
_GAP = re.compile(r"[ \t\r\n,;.]{0,3}")
SEPARATORS = 11
TAGS = ("01", "100", "101", "102")


def checksum_holds(bits: int, words: int) -> bool:
    """bits: 11 a word. Of these, the last (one for every three words) are the first of the SHA-256 of the others."""
    check = words // 3
    entropy = (bits >> check).to_bytes((11 * words - check) // 8, "big")
    return hashlib.sha256(entropy).digest()[0] >> (8 - check) == bits & ((1 << check) - 1)


def tag_holds(words: list[str]) -> bool:
    """The keyed digest of the phrase starts with one of the tags."""
    return hmac.new(b"Seed version", " ".join(words).encode(), hashlib.sha512).hexdigest().startswith(TAGS)


def runs(text: str, index: Mapping[str, int]) -> Iterator[list[re.Match]]:
    """Stretches of words of the list, each close to the next, that are long enough for a phrase."""
    run: list[re.Match] = []
    for m in _WORD.finditer(text):
        known = m[0].lower() in index
        if run and not (known and _GAP.fullmatch(text, run[-1].end(), m.start())):
            if len(run) >= LENGTHS[-1]:
                yield run
            run = []
        if known:
            run.append(m)
    if len(run) >= LENGTHS[-1]:
        yield run


def valid_windows(words: list[str], index: Mapping[str, int]) -> Iterator[tuple[int, int]]:
    """(first word, number of words) of every window that is a phrase; at each place the longest one.

    A run is one bit string, seen through a window of the longest phrase's bits that moves on by a word: a shorter phrase is a shift of it.
    """
    longest = LENGTHS[0]
    numbers = [index[w] for w in words] + [0] * longest
    seen = 0
    for number in numbers[: longest - 1]:
        seen = seen << 11 | number
    for first in range(len(words)):
        seen = (seen << 11 | numbers[first + longest - 1]) & ((1 << 11 * longest) - 1)
        for n in LENGTHS:
            if first + n <= len(words) and (checksum_holds(seen >> 11 * (longest - n), n) or tag_holds(words[first : first + n])):
                yield first, n
                break


def phrases(text: str, index: Mapping[str, int]) -> list[tuple[int, int, int]]:
    """(start, end, words) of each phrase: the earliest first, at its place the longest, none inside another."""
    if sum(map(text.count, " \n,;")) < SEPARATORS:
        return []
    out: list[tuple[int, int, int]] = []
    for run in runs(text, index):
        free = 0
        for first, n in valid_windows([m[0].lower() for m in run], index):
            if first >= free:
                out.append((run[first].start(), run[first + n - 1].end(), n))
                free = first + n
    return out
