"""Conversation repair against a plain program over rows, texts and whole audits."""

import hashlib
import itertools
import random
import re
import zlib

from leaksieve.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, kind string, audit string"
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(symbols):
    """Least (cost, audit) over every sequence of edits, by (state, cost, audit) sets with whole texts."""
    best = {"": (0, "")}

    def inserted(cells):
        cells = dict(cells)
        for _ in range(3):
            for at, (cost, audit) in list(cells.items()):
                for role in "ua":
                    if role in STEP[at]:
                        found = (cost + 3, audit + "I")
                        to = STEP[at][role]
                        cells[to] = min(cells.get(to, found), found)
        return cells

    for role, fault in symbols:
        after = {}
        for at, (cost, audit) in inserted(best).items():
            extra = 3 if fault == "truncated" else 0
            ways = [(cost + 4, audit + "D", at)]
            if fault not in ("blank", "duplicate"):
                if role in STEP[at]:
                    ways.append((cost + extra, audit + "K", STEP[at][role]))
                ways += [(cost + 3 + extra, audit + "R", STEP[at][r]) for r in "ua" if r in STEP[at]]
            for c, a, to in ways:
                after[to] = min(after.get(to, (c, a)), (c, a))
        best = after
    return min(v for at, v in inserted(best).items() if at in ("", "a"))


def exhaustive(symbols, most):
    """The same by listing every audit with up to `most` insertions."""
    found = []

    def go(i, at, cost, audit, left):
        if i == len(symbols) and at in ("", "a"):
            found.append((cost, audit))
        if left:
            for r in "ua":
                if r in STEP[at]:
                    go(i, STEP[at][r], cost + 3, audit + "I", left - 1)
        if i < len(symbols):
            role, fault = symbols[i]
            extra = 3 if fault == "truncated" else 0
            go(i + 1, at, cost + 4, audit + "D", left)
            if fault not in ("blank", "duplicate"):
                if role in STEP[at]:
                    go(i + 1, STEP[at][role], cost + extra, audit + "K", left)
                for r in "ua":
                    if r in STEP[at]:
                        go(i + 1, STEP[at][r], cost + 3 + extra, audit + "R", left)

    go(0, "", 0, "", most)
    return min(found)


def encoded(symbols):
    out = ""
    for role, fault in symbols:
        c = role if role in ("s", "u", "a") else "x"
        out += "d" if fault in ("blank", "duplicate") else c.upper() if fault == "truncated" else c
    return out


def test_all_short_sequences():
    every = [(r, f) for r in ("s", "u", "a", "t") for f in ("", "truncated")] + [("u", "blank")]
    grammar = C.Grammar([(1, 2), (9, 9), (9, 1), (0, 1), (8, 8), (8, 12), (10, 10)])
    for n in range(4):
        for symbols in itertools.product(every, repeat=n):
            want = exhaustive(symbols, 3)
            assert cheapest(symbols) == want
            text = encoded(symbols)
            assert C.Grammar([]).audit([C.SYMBOLS.index(c) for c in text]) == want
            assert grammar.audit(grammar.compress(text)) == want


def test_long_sequences_by_rules():
    rng = random.Random(3)
    for _ in range(40):
        symbols = [(rng.choice("suaat"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(1, 200))]
        rules = [(1, 2), (9, 9), (2, 1), (8, 1), (10, 10), (0, 9), (4, 3), (7, 8), (13, 13), (6, 5), (8, 8), (19, 19)]
        grammar = C.Grammar(rules)
        assert grammar.audit(grammar.compress(encoded(symbols))) == cheapest(symbols)


def brute(rows):
    """Every column of the result from the raw rows."""
    text_of = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in rows}:
        have = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            hit = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
            role, text = text_of(role), text_of(text)
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            role = "user" if hit == 4 else role
            have += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
        have.sort()
        seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in have:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            symbols.append((role[:1], fault))
        cost, audit = cheapest(symbols) if have else (0, "")
        kept, at, todo = [], "", iter(have)
        for letter in audit:
            row = None if letter == "I" else next(todo)
            if letter == "D":
                continue
            role = row[2] if letter == "K" else "assistant" if at == "u" else "user"
            at = role[0]
            kept.append(f"{role}:{'' if row is None else row[4]}")
        turns = {t for timed, t, *_ in have if timed}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(have, have[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = C.repaired(df).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == brute(rows)


def test_random_conversations(spark):
    rng = random.Random(8)
    texts = ["Hi.", "Yes!", "no", "", " \n\t", "What?  ", "a.b", "Long " * 3 + ".", None, "é…", "end.\n"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(texts)))
    rows += rows[:40]  # repeated rows
    rows += [(1000 + i, t, r, f"{i} {t}.") for i in range(30) for t, r in enumerate(["user", "assistant"] * 3)]
    check(spark, rows)


def test_long_conversation_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two", "x" * 50_000 + "!", f"t{t}."])) for t in range(300)]
    rows += [(5, 40, "user", "Same.")] * 60 + [(6, 0, "user", "Hi.")]
    check(spark, rows)


def test_odd_tables(spark):
    assert C.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = C.repaired(spark.createDataFrame([(3, dropped, "user", "x", "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
