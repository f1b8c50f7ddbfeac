"""Scalar expressions over texts, paths and lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(value: Column) -> Column:
    """Up to 12 code points: the first 3 and stars; else the first 6, eight stars and the last 4."""
    n = F.length(value)
    short = F.concat(F.substring(value, 1, 3), F.repeat(F.lit("*"), F.greatest(n - 3, F.lit(0))))
    return F.when(n <= 12, short).otherwise(F.concat(F.substring(value, 1, 6), F.lit("*" * 8), F.right(value, F.lit(4))))


def fingerprint(relpath: Column, line: Column, rule: Column) -> Column:
    return F.concat_ws(":", relpath, line.cast("string"), rule)


def file_uri(path: Column) -> Column:
    """A path as a URI: percent-encoded, with file:// before an absolute one; what has a scheme already stays."""
    encoded = F.url_encode(path)
    for was, becomes in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(was), F.lit(becomes))
    return F.when(path.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]+:/"), path).when(F.startswith(path, F.lit("/")), F.concat(F.lit("file://"), encoded)).otherwise(encoded)


def relative_path(file: Column, root: str) -> Column:
    """The path below root; the whole path where it lies elsewhere."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(file, F.lit(top)), F.substring(file, F.lit(len(top) + 1), F.length(file))).otherwise(file)


def glob_pattern(glob: str) -> str:
    """A shell glob over a whole path as a JVM pattern: * and ? cross slashes, [..] and [!..] are classes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def ignore_kind(line: Column) -> Column:
    """(kind, entry) of a line of an ignore file; null for blanks and comments.

    Order: comment or blank, ``rule:``, fingerprint (path:digits:rule), ``path:``, else a literal value.
    """
    text = F.trim(line)
    as_ = lambda kind, entry: F.struct(F.lit(kind).alias("kind"), entry.alias("entry"))
    after = lambda n: F.trim(F.substring(text, F.lit(n + 1), F.length(text)))
    return (
        F.when((text == "") | F.startswith(text, F.lit("#")), F.lit(None))
        .when(F.startswith(text, F.lit("rule:")), as_("rule", after(5)))
        .when(text.rlike(r"(?s)\A.+:[0-9]+:[^:]+\z"), as_("fingerprint", text))
        .when(F.startswith(text, F.lit("path:")), as_("path", after(5)))
        .otherwise(as_("value", text))
    )


def check_template(template: str) -> str:
    """A redaction template: a non-empty text whose only field is {rule}, without slashes, control or line-breaking characters."""
    bare = template.replace("{rule}", "")
    if not template or "{" in bare or "}" in bare:
        raise ValueError("a template may hold {rule} and no other field")
    if re.search("[/\\\\\x00-\x1f\x7f-\x9f\u2028\u2029]", template):
        raise ValueError("a template can't hold slashes, control or line-breaking characters")
    return template


def physical_lines(text: Column) -> Column:
    """Array of lines with their ends: \\r\\n, \\r and \\n break lines, wide separators don't."""
    return F.regexp_extract_all(text, F.lit(r"(?d)[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\z"), F.lit(0))


def line_end(line: Column) -> Column:
    return F.regexp_extract(line, r"(\r\n|\r|\n)?\z", 1)


def without_end(line: Column) -> Column:
    return F.regexp_replace(line, r"(?:\r\n|\r|\n)\z", "")


def text_lines(text: Column) -> Column:
    """Array of lines of a plain text; here the wide separators and form feeds break lines as well."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
