"""Conversation structure repair by a grammar-compressed dynamic program.

Each conversation's rows, in order, become symbols: what the role begins with (system, user, assistant, other) and the fault
(none, truncated, or one that forces deletion). Re-Pair over the distinct symbol sequences of the corpus replaces frequent
pairs by rules, round by round; a rule carries one min-plus transfer matrix over the states of the role pattern, with the
middle state of each cell as its audit rope and the cells' lexicographic ranks. Matrices are evaluated bottom-up, once a rule, and all
conversations share them: a conversation is the product of the few symbols that are left of it, its audit is read off the ropes.

The state of an audit determines it: an audit and a start state lead to one end state, and every audit of a symbol ends with the row's own
letter, so no audit of a cell begins another one. Ranks therefore decide ties among cheapest audits without comparing texts.

Rows are put in order by range over (conversation, turn, role, text digest), so a long conversation is cut into blocks over
many tasks; equal rows are counted before they are exchanged. What meets in one row is a conversation's compressed symbols and its audit, which is one
value of the result. The digest of a repaired conversation is one serial chain by definition: its texts stream, sorted, through one task.

Defined results: null role and text, and null conv_id and turn inside the damage key, read as one space; rows without a turn come
first; rows of one turn are ordered by role, then by the text's SHA-256, so repeated rows lie side by side; a null conv_id is a conversation; other roles
than system, user and assistant can't be kept, only reroled or deleted; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged

#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES = 4
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ACCEPTED = (0, 3)
#: Symbols: the role's initial (x: any other), as a capital if truncated; d: a row that has to go.
SYMBOLS = "suaxSUAXd"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INFINITE = 1 << 60
BLOCK = 4096


class Transfer(NamedTuple):
    """Cells by start * 4 + end: cost, middle state (of a rule; the audit itself of a terminal) and rank among the start's cells."""

    cost: tuple[int, ...]
    middle: tuple
    rank: tuple[int, ...]


def insertions(state: int) -> list[int]:
    """The states that 0, 1, 2.. inserted rows lead to, while they are new."""
    seen = [state]
    while True:
        at = next(q for q in (NEXT["u"][seen[-1]], NEXT["a"][seen[-1]]) if q is not None)
        if at in seen:
            return seen
        seen.append(at)


@lru_cache(maxsize=1)
def terminals() -> list[Transfer]:
    """One matrix per symbol: any insertions, then the row kept, reroled or deleted."""
    out = []
    for symbol in SYMBOLS:
        cells: dict[tuple[int, int], tuple[int, str]] = {}
        for start in range(STATES):
            for n, at in enumerate(insertions(start)):
                moves = [(DELETE, "D", at)]
                if symbol != "d":
                    extra = TRUNCATED if symbol.isupper() else 0
                    keep = NEXT[symbol.lower()][at] if symbol.lower() in NEXT else None
                    moves += [(extra, "K", keep)] + [(REROLE + extra, "R", NEXT[role][at]) for role in "ua"]
                for cost, letter, end in moves:
                    if end is not None:
                        found = (cost + INSERT * n, "I" * n + letter)
                        cells[start, end] = min(cells.get((start, end), found), found)
        flat = [cells.get((p, q), (INFINITE, None)) for p in range(STATES) for q in range(STATES)]
        ranks = []
        for p in range(STATES):
            row = flat[p * STATES : (p + 1) * STATES]
            order = sorted(a for _, a in row if a is not None)
            ranks += [order.index(a) if a is not None else STATES for _, a in row]
        out.append(Transfer(tuple(c for c, _ in flat), tuple(a for _, a in flat), tuple(ranks)))
    return out


def product(left: Transfer, right: Transfer) -> Transfer:
    """The matrix of left followed by right."""
    cost, middle, keys = [], [], []
    for p in range(STATES):
        for q in range(STATES):
            ways = [(left.cost[p * 4 + r] + right.cost[r * 4 + q], left.rank[p * 4 + r], r) for r in range(STATES) if left.cost[p * 4 + r] < INFINITE and right.cost[r * 4 + q] < INFINITE]
            best = min(ways, default=(INFINITE, STATES, None))
            cost.append(best[0])
            middle.append(best[2])
            keys.append((best[1], right.rank[best[2] * 4 + q]) if ways else None)
    ranks = []
    for p in range(STATES):
        order = sorted(k for k in keys[p * 4 : p * 4 + 4] if k)
        ranks += [order.index(k) if k else STATES for k in keys[p * 4 : p * 4 + 4]]
    return Transfer(tuple(cost), tuple(middle), tuple(ranks))


class Grammar:
    """Re-Pair rules (pairs of symbols; rule k is symbol 9 + k) and their matrices, evaluated bottom-up."""

    def __init__(self, rules: Sequence[tuple[int, int]]):
        self.rules = [tuple(r) for r in rules]
        self.transfers = list(terminals())
        for a, b in self.rules:
            self.transfers.append(product(self.transfers[a], self.transfers[b]))
        self.index = {pair: k for k, pair in reversed(list(enumerate(self.rules)))}
        self.compress = lru_cache(maxsize=4096)(self._compress)

    def _compress(self, symbols: str) -> tuple[int, ...]:
        """Rules in their order; a rule's symbol only occurs in later rules, so the first one that applies is always the next."""
        out = [SYMBOLS.index(c) for c in symbols]
        while True:
            k = min((self.index[p] for p in zip(out, out[1:], strict=False) if p in self.index), default=None)
            if k is None:
                return tuple(out)
            out = replaced(out, self.rules[k], len(SYMBOLS) + k)

    def audit(self, symbols: Sequence[int]) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair of a compressed sequence, the least audit of a tie."""
        state = {0: (0, 0)}  # end state -> (cost, rank of the audit so far)
        steps = []
        for s in symbols:
            t = self.transfers[s]
            ways = {}
            for q in range(STATES):
                found = [(cost + t.cost[p * 4 + q], rank, t.rank[p * 4 + q], p) for p, (cost, rank) in state.items() if t.cost[p * 4 + q] < INFINITE]
                if found:
                    ways[q] = min(found)
            order = sorted((w[1], w[2]) for w in ways.values())
            state = {q: (w[0], order.index((w[1], w[2]))) for q, w in ways.items()}
            steps.append((s, {q: w[3] for q, w in ways.items()}))
        ends = []
        for q, (cost, rank) in state.items():
            n, _ = next((n, at) for n, at in enumerate(insertions(q)) if at in ACCEPTED)
            ends.append((cost + INSERT * n, rank, n, q))
        cost, _, n, at = min(ends)
        letters = ["I" * n]
        for s, back in reversed(steps):
            letters.append(self._letters(s, back[at], at))
            at = back[at]
        return cost, "".join(reversed(letters))

    def _letters(self, symbol: int, start: int, end: int) -> str:
        out, todo = [], [(symbol, start, end)]
        while todo:
            s, p, q = todo.pop()
            middle = self.transfers[s].middle[p * 4 + q]
            if s < len(SYMBOLS):
                out.append(middle)
            else:
                a, b = self.rules[s - len(SYMBOLS)]
                todo += [(b, middle, q), (a, p, middle)]
        return "".join(out)


def replaced(symbols: Sequence[int], pair: tuple[int, int], new: int) -> list[int]:
    """The sequence with each occurrence of a pair, from the left, replaced by a new symbol."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of a partition, counted; overlapping equal pairs (aaa) count from the left."""
    counts: Counter = Counter()
    for batch in batches:
        for symbols in batch["body"].to_pylist():
            last = None
            for pair in zip(symbols, symbols[1:], strict=False):
                if pair == last and pair[0] == pair[1]:
                    last = None
                    continue
                counts[pair] += 1
                last = pair
    yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in counts], pa.int32()), "b": pa.array([b for _, b in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})


def re_pair(sequences: DataFrame, most: int = 512, a_round: int = 64, rounds: int = 12) -> list[tuple[int, int]]:
    """Rules for the distinct sequences in column symbols: the most frequent pairs of each round, until none occurs twice.

    The bounds (rules, rules a round, rounds) limit the dictionary that reaches the driver, not what is repaired: what stays uncompressed is multiplied out.
    """
    table = F.create_map(*(x for i, c in enumerate(SYMBOLS) for x in (F.lit(c), F.lit(i))))
    body = staged(sequences.select(F.transform(F.filter(F.split("symbols", ""), lambda c: c != ""), lambda c: table[c]).alias("body")).where(F.size("body") > 1))
    rules: list[tuple[int, int]] = []
    for _ in range(rounds):
        counts = body.mapInArrow(_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
        found = [(r.a, r.b) for r in counts.orderBy(F.desc("n"), "a", "b").limit(min(a_round, most - len(rules))).collect()]
        if not found:
            break
        first = len(SYMBOLS) + len(rules)
        rules += found

        def shorten(batches: Iterator[pa.RecordBatch], found=tuple(found), first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for symbols in batch["body"].to_pylist():
                    for k, pair in enumerate(found):
                        symbols = replaced(symbols, pair, first + k)
                    if len(symbols) > 1:
                        out.append(symbols)
                yield pa.RecordBatch.from_pydict({"body": pa.array(out, pa.list_(pa.int32()))})

        if len(rules) >= most:
            break
        body = staged(body.mapInArrow(shorten, "body array<int>"))
    return rules


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: the row is dropped) after the damage that the key of each row decides."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), part("role").alias("role"), part("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).cast("long").alias("copies"))


_PLACE = ("conv_id", "timed", "turn", "role", "digest")  # rows without a turn come first


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("copies") > 0).withColumns({"timed": F.col("turn").isNotNull(), "digest": F.unhex(F.sha2("text", 256))})


def _symbol(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(kind)).otherwise(kind)


_BLOCK = "conv_id long, timed boolean, turn long, role string, digest binary, k long, symbols string, first string, last string, illegal long, n_rows long"
_BLOCK_TYPES = pa.schema([("conv_id", pa.int64()), ("timed", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("k", pa.int64()), ("symbols", pa.string()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("n_rows", pa.int64())])
LEGAL = ("su", "ua", "au")


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks of symbols: a block begins with a conversation, a task, or after BLOCK symbols."""
    block: dict | None = None
    done: list[dict] = []
    k = 0  # tells blocks that begin within one row's copies

    def close() -> None:
        if block is not None:
            done.append(block | {"symbols": "".join(block["symbols"])})

    for batch in batches:
        for r in batch.to_pylist():
            initial = r["role"][:1]
            left = r["copies"]
            while left:
                if block is None or block["conv_id"] != r["conv_id"] or block["n_rows"] >= BLOCK:
                    close()
                    k += 1
                    block = {"k": k, "conv_id": r["conv_id"], "timed": r["timed"], "turn": r["turn"], "role": r["role"], "digest": r["digest"], "symbols": [], "first": initial, "last": None, "illegal": 0, "n_rows": 0}
                room = min(left, BLOCK - block["n_rows"])
                fresh = left == r["copies"]
                block["symbols"].append(r["symbol"] + "d" * (room - 1) if fresh else "d" * room)  # a copy is a duplicate
                if block["last"] is not None:
                    block["illegal"] += block["last"] + initial not in LEGAL
                block["illegal"] += (room - 1) * (initial + initial not in LEGAL)
                block["last"], block["n_rows"], left = initial, block["n_rows"] + room, left - room
        if len(done) >= 1000:
            yield from pa.Table.from_pylist(done, _BLOCK_TYPES).to_batches()
            done = []
    close()
    yield from pa.Table.from_pylist(done, _BLOCK_TYPES).to_batches()


def _audits(rules: list[tuple[int, int]]):
    """conv_id and its blocks in order -> cost, audit, illegal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        whole = lru_cache(maxsize=4096)(grammar.audit)  # equal conversations are worked out once
        for batch in batches:
            out = []
            for conv, blocks in zip(batch["conv_id"].to_pylist(), batch["blocks"].to_pylist(), strict=True):
                symbols = tuple(s for b in blocks for s in grammar.compress(b["symbols"]))
                cost, audit = whole(symbols)
                illegal = sum(b["illegal"] for b in blocks) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:], strict=False))
                out.append({"conv_id": conv, "cost": cost, "audit": audit, "illegal": illegal})
            yield from pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])).to_batches()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stream of an audit followed by its conversation's rows -> the SHA-256 of the repaired rows."""

    def stream():
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")), strict=True)

    out: list[tuple] = []
    for conv, rows in groupby(stream(), key=lambda r: r[0]):
        audit = next(rows)[1]
        digest, state, at, written = hashlib.sha256(), 0, 0, False

        def put(role: str, text: str) -> None:
            nonlocal state, written
            state = NEXT[role[0]][state]
            digest.update((("\n" if written else "") + role + ":").encode())
            digest.update(text.encode("utf-8", "replace"))
            written = True

        def turn_role() -> str:
            return "assistant" if state == 2 else "user"

        for _, _, role, text, copies in rows:
            for _ in range(copies):
                while audit[at] == "I":
                    put(turn_role(), "")
                    at += 1
                if audit[at] == "K":
                    put(role, text)
                elif audit[at] == "R":
                    put(turn_role(), text)
                at += 1
        for _ in audit[at:]:
            put(turn_role(), "")
        out.append((conv, digest.hexdigest()))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in out], pa.int64()), "repaired_sha256": pa.array([d for _, d in out])})
            out = []
    yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in out], pa.int64()), "repaired_sha256": pa.array([d for _, d in out], pa.string())})


def faults(rows: DataFrame) -> DataFrame:
    """Each different row (conv_id, timed, turn, role, digest) with copies, the fault of its first copy (further ones are duplicates) and symbol."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    open_ended = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    narrow = _keyed(rows).select(*_PLACE, "copies", blank.alias("blank"), open_ended.alias("open_ended"))
    each = staged(narrow.groupBy(*_PLACE, "blank", "open_ended").agg(F.sum("copies").alias("copies")))
    firsts = each.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("timed", "turn")).alias("first"))
    # the key as one value that is never null, so that null conversations join as well
    key = lambda d: d.withColumn("id", F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "role", F.hex("digest")), 256))
    joined = key(each).join(key(firsts).select("id", "first"), "id")
    later = ~F.struct("timed", "turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("open_ended"), "truncated").otherwise("")
    return joined.select(*_PLACE, "copies", fault.alias("fault")).withColumn("symbol", _symbol(F.col("role"), F.col("fault")))


def repaired(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation (damaged first)."""
    return repair(damaged(df))


def repair(rows: DataFrame) -> DataFrame:
    """The same for rows (conv_id, turn, role, text, copies) as they are: a row counts copies times, with 0 only its conversation is named."""
    marked = staged(faults(rows))
    ordered = marked.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    blocks = staged(ordered.select(*_PLACE, "copies", "symbol").mapInArrow(_to_blocks, _BLOCK))
    rules = re_pair(blocks.select("symbols").distinct())
    listed = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("timed", "turn", "role", "digest", "k", "symbols", "first", "last", "illegal"))).alias("blocks"))
    audits = staged(listed.select("conv_id", "blocks").mapInArrow(_audits(rules), "conv_id long, cost long, audit string, illegal long"))
    # one sorted stream: a conversation's audit, then its rows
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("boolean").alias("timed"), F.lit(None).cast("long").alias("turn"), "audit", F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    bodies = _keyed(rows).select("conv_id", F.lit(1).alias("kind"), "timed", "turn", F.lit(None).cast("string").alias("audit"), "role", "digest", "text", "copies")
    stream = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "timed", "turn", "role", "digest")
    digests = stream.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    n = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).alias(fault)
    turns = marked.groupBy("conv_id", "turn").agg(n("blank"), n("duplicate"), n("truncated"), F.sum(F.when(F.col("fault") != "blank", F.col("copies") - 1).otherwise(0)).alias("more"), F.sum(F.when(F.col("fault") == "blank", F.col("copies") - 1).otherwise(0)).alias("more_blank"))
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), (F.sum("blank") + F.sum("more_blank")).alias("blank"), (F.sum("duplicate") + F.sum("more")).alias("duplicate"), F.sum("truncated").alias("truncated")
    )
    every = rows.select("conv_id").distinct()
    flag = lambda d: d.withColumn("known", F.col("conv_id").isNotNull()).fillna(0, ["conv_id"])  # noqa: E731  null conversations join by this pair
    keys = ["conv_id", "known"]
    out = flag(every).join(flag(counts), keys, "left").join(flag(audits), keys, "left").join(flag(digests), keys, "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.when(F.col("known"), F.col("conv_id")).alias("conv_id"),
        *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


#: The same by a recursion over rows and states that carries whole audits and texts. CRC-32 goes byte by byte and bit by bit through a list.
SQL = r"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1), lambda i: [ascii(substr(key, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) % 20 AS hit FROM k),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn FROM d),
f AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY rn) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
counts AS (SELECT conv_id, max(rn) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, '', ''), (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, '', ''), (1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (3, 3, '', ''), (3, 2, 'I', chr(10) || 'user:')) t(p, q, letters, body)),
act AS (SELECT * FROM (VALUES ('D', '', 0, 0, 4, ''), ('D', '', 1, 1, 4, ''), ('D', '', 2, 2, 4, ''), ('D', '', 3, 3, 4, ''), ('K', 's', 0, 1, 0, ''), ('K', 'u', 0, 2, 0, ''), ('K', 'u', 1, 2, 0, ''), ('K', 'u', 3, 2, 0, ''), ('K', 'a', 2, 3, 0, ''),
  ('R', 'u', 0, 2, 3, 'user'), ('R', 'u', 1, 2, 3, 'user'), ('R', 'u', 3, 2, 3, 'user'), ('R', 'a', 2, 3, 3, 'assistant')) t(letter, c, p, q, price, name)),
dp AS (
  SELECT conv_id, 0::BIGINT AS rn, 0 AS st, {'cost': 0::BIGINT, 'audit': '', 'body': ''} AS best FROM counts
  UNION ALL
  SELECT conv_id, rn, st, min(way) FROM (
    SELECT dp.conv_id, f.rn, act.q AS st, {'cost': dp.best.cost + 3 * length(ins.letters) + act.price + CASE WHEN f.fault = 'truncated' AND act.letter <> 'D' THEN 3 ELSE 0 END, 'audit': dp.best.audit || ins.letters || act.letter,
      'body': dp.best.body || ins.body || CASE act.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || act.name || ':' || f.text END} AS way
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.rn = dp.rn + 1 JOIN ins ON ins.p = dp.st
    JOIN act ON act.p = ins.q AND (act.letter = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (act.letter = 'R' OR act.c = substr(f.role, 1, 1))))) GROUP BY conv_id, rn, st),
ends AS (SELECT conv_id, min(way) AS way FROM (
  SELECT dp.conv_id, {'cost': dp.best.cost + 3 * length(ins.letters), 'audit': dp.best.audit || ins.letters, 'body': dp.best.body || ins.body} AS way
  FROM dp JOIN counts ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND counts.n = dp.rn JOIN ins ON ins.p = dp.st AND ins.q IN (0, 3)) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost,
  coalesce(way.audit, '') AS audit, sha256(coalesce(substr(way.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""
