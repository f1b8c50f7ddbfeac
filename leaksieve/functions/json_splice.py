"""Replace string values inside a JSON text without touching any other byte of it.

A tokeniser walks the text once and gives the place of every string value with its key path; replacements are spliced in at
those places. The result counts only if it parses to the same document with just those strings changed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:,]|[^\s"{}\[\]:,]+', re.DOTALL)


def string_values(text: str) -> Iterator[tuple[tuple, int, int]]:
    """(key path, start, end) of every string value of a valid JSON text, quotes included, in text order; keys don't count."""
    path: list = []
    objects: list[bool] = []  # whether each open container is an object
    key_next = False
    for m in _TOKEN.finditer(text):
        token = m[0]
        first = token[0]
        if first == '"':
            if key_next:
                path[-1] = json.loads(token)
            else:
                yield tuple(path), m.start(), m.end()
        elif first in "{[":
            objects.append(first == "{")
            path.append(None if first == "{" else 0)
            key_next = objects[-1]
        elif first in "}]":
            objects.pop()
            path.pop()
            key_next = False
        elif first == ":":
            key_next = False
        elif first == ",":
            if objects[-1]:
                key_next = True
            else:
                path[-1] += 1


class Refused(ValueError):
    """The text can't be rewritten safely: it no longer parses, or a path doesn't lead to the string it should."""


def _at(doc, path: tuple):
    for k in path:
        if not isinstance(doc, dict if isinstance(k, str) else list):
            raise Refused("a path leads nowhere")
        doc = doc[k]
    return doc


def edited(text: str, edits: Sequence[Mapping]) -> str:
    """The text with spans (start, end in code points, was, text; in order) replaced; raises Refused where a span no longer holds what it did."""
    out, at = [], 0
    for e in edits:
        if e["start"] < at or text[e["start"] : e["end"]] != e["was"]:
            raise Refused("the text is not the one that was scanned")
        out += [text[at : e["start"]], e["text"]]
        at = e["end"]
    return "".join([*out, text[at:]])


def spliced(text: str, changes: Mapping[tuple, str | Callable[[str], str]]) -> str:
    """The text with the strings at the given key paths replaced, by a text or by what a function makes of the old one; raises Refused.

    Repeated keys: the last one is the value, as parsers have it. Where an earlier one under a changed path holds another string, the text is refused,
    since that string was never scanned.
    """
    try:
        doc = json.loads(text)
        old = {path: _at(doc, path) for path in changes}
    except (ValueError, RecursionError, KeyError, IndexError) as e:
        raise Refused(str(e)) from e
    if not all(isinstance(v, str) for v in old.values()):
        raise Refused("a path doesn't lead to a string")
    changes = {path: new(old[path]) if callable(new) else new for path, new in changes.items()}
    out, at, met = [], 0, set()
    for path, start, end in string_values(text):
        if path in changes:
            token = text[start:end]
            if json.loads(token) != old[path]:
                raise Refused("a key is repeated with different texts")
            out += [text[at:start], json.dumps(changes[path], ensure_ascii=token.isascii() and "\\u" in token)]
            at = end
            met.add(path)
    new = "".join([*out, text[at:]])
    for path, value in changes.items():
        if not path:
            doc = value
        else:
            _at(doc, path[:-1])[path[-1]] = value
    if met != set(changes) or json.loads(new) != doc:
        raise Refused("the rewritten text isn't the changed document")
    return new


def respelled(text: str, change: Callable[[str], str | None]) -> tuple[str, int]:
    """(text, number of changed strings) with every string value for which change gives a new one rewritten in place; raises Refused where it isn't JSON.

    Every occurrence counts, those under repeated keys as well.
    """
    try:
        json.loads(text)
    except (ValueError, RecursionError) as e:
        raise Refused(str(e)) from e
    out, at = [], 0
    for _, start, end in string_values(text):
        token = text[start:end]
        new = change(json.loads(token))
        if new is not None:
            out += [text[at:start], json.dumps(new, ensure_ascii=token.isascii() and "\\u" in token)]
            at = end
    return "".join([*out, text[at:]]), len(out) // 2
