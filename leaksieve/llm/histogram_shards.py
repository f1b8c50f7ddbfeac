"""Histogram sort into shards of near-equal bytes, with built-in expressions only.

Rows are ordered by a composite key of long columns. Candidate boundaries are refined digit by digit: each round counts
the exact bytes and rows of the cells (key prefixes) that a wanted splitter can still fall in, across all partitions, and
keeps refining the cells whose edges miss a splitter by more than the tolerance. When every splitter is settled, rows are
exchanged once, by a fine range of the key, and get their shard and their slot there.

Law ``bytes``: a splitter sits at the row edge nearest to its share of the bytes (tolerance 0), so a shard is off by
at most one row's size. Equal texts lie side by side in key order, so a group of copies spans as few shards as its
bytes allow and a hot group is cut rather than overfilling one.

Defined results: a null text has 16 bytes and the checksum of the empty text; a null doc_id sorts first; rows equal in
key share a cell and are told apart by nothing, so they stay together; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged, text_of

#: Bits of a key that one round resolves, and rows (mean) of a range in the final exchange.
DIGIT, RANGE_ROWS = 12, 20_000


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5: copies meet, and any engine gives the same order."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(bits: list[int], depth: int) -> Column:
    """The first ``depth`` bits of the concatenated key columns k0, k1..: one long per column."""
    parts, left = [], depth
    for i, b in enumerate(bits):
        take = min(b, max(left, 0))
        parts.append(F.shiftright(F.col(f"k{i}"), b - take))
        left -= b
    return F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))


def splitters(rows: DataFrame, bits: list[int], targets: list[int], tolerance: int) -> list[dict]:
    """For each wanted byte offset the settled edge: {"depth", "cell", "bytes", "rows"}: all rows below the cell come before it.

    rows: k0.. (non-negative longs of the given bits) and size. What reaches the driver is one cell for each target and round.
    """
    total_bits = sum(bits)
    spark = rows.sparkSession
    settled: list[dict | None] = [None] * len(targets)
    open_cells = [{"target": i, "cell": None, "bytes": 0, "rows": 0} for i in range(len(targets))]
    depth = 0
    while open_cells:
        deeper = min(total_bits, depth + DIGIT)
        if depth == 0:
            inside = rows.withColumn("parent", F.lit(0))
            parents = {None: 0}
        else:
            cells = list(dict.fromkeys(c["cell"] for c in open_cells))
            parents = {c: n for n, c in enumerate(cells)}
            names = [f"p{i}" for i in range(len(bits))]
            near = spark.createDataFrame([(*c, n) for c, n in parents.items()], ", ".join(f"{p} long" for p in names) + ", parent int")
            prefix = _prefix(bits, depth)
            inside = rows.withColumns({p: prefix[p] for p in names}).join(F.broadcast(near), names).drop(*names)
        counted = inside.groupBy("parent", _prefix(bits, deeper).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        counted = staged(counted)
        wanted = spark.createDataFrame([(c["target"], parents[c["cell"]], c["bytes"], c["rows"], int(targets[c["target"]])) for c in open_cells], "target int, parent int, base long, base_rows long, want long")
        found = _crossing(counted, wanted)
        now = []
        for row in found:
            cell, low, high = tuple(row.cell), row.low, row.low + row.bytes
            want = targets[row.target]
            done = min(abs(want - low), abs(want - high)) <= tolerance or row.rows == 1 or deeper == total_bits
            if done:
                # ties go to the edge above the cell only if it is strictly nearer
                after = high - want < want - low
                settled[row.target] = {"depth": deeper, "cell": cell, "after": after, "bytes": high if after else low, "rows": row.low_rows + (row.rows if after else 0)}
            else:
                now.append({"target": row.target, "cell": cell, "bytes": low, "rows": row.low_rows})
        open_cells, depth = now, deeper
    return settled


def _crossing(counted: DataFrame, wanted: DataFrame) -> list:
    """For each target the cell that its byte offset falls in, with the bytes and rows before it.

    A round has at most 2**DIGIT cells for each open parent, so a parent's running sum is a bounded window.
    """
    before = Window.partitionBy("parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    running = counted.withColumns({"below": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "below_rows": F.coalesce(F.sum("rows").over(before), F.lit(0))})
    hit = running.join(F.broadcast(wanted), "parent").where((F.col("base") + F.col("below") <= F.col("want")) & (F.col("want") < F.col("base") + F.col("below") + F.col("bytes")))
    return hit.select("target", "cell", "bytes", "rows", (F.col("base") + F.col("below")).alias("low"), (F.col("base_rows") + F.col("below_rows")).alias("low_rows")).collect()


def _edge(bits: list[int], s: dict) -> tuple[int, int]:
    """The lowest key at or after the splitter."""
    taken = min(s["depth"], bits[0]), max(0, s["depth"] - bits[0])
    number = (s["cell"][0] << taken[1] | s["cell"][1]) + s["after"]
    number <<= sum(bits) - s["depth"]
    return number >> bits[1], number & (1 << bits[1]) - 1


def histogram_shards(rows: DataFrame, key: Column, tie: Column, size: Column, shards: int = 40, tolerance: float = 0.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with shard (0..) and slot (gapless from 0 in the order of key, then tie, within the shard).

    tolerance: how far a splitter may miss its share of the bytes, as a part of a shard's mean bytes.
    """
    raw = rows.withColumns({"k0": key.cast("long"), "k1": tie.cast("long"), "_size": size.cast("long")})
    ends = raw.agg(*(f(k).alias(n + k) for k in ("k0", "k1") for n, f in (("lo", F.min), ("hi", F.max))), F.sum("_size").alias("total"), F.count(F.lit(1)).alias("n")).first()
    low = [ends[f"lo{k}"] or 0 for k in ("k0", "k1")]
    bits = [max(1, ((ends[f"hi{k}"] or 0) - lo + 1).bit_length()) for k, lo in zip(("k0", "k1"), low, strict=True)]
    keyed = staged(raw.withColumns({k: F.coalesce(F.col(k) - F.lit(lo) + 1, F.lit(0)) for k, lo in zip(("k0", "k1"), low, strict=True)}))  # null: before the lowest
    n, total = ends["n"], ends["total"] or 0
    # sizes count in parts of 1/shards byte, so that every wanted offset is whole
    found = splitters(keyed.select("k0", "k1", (F.col("_size") * shards).alias("size")), bits, [total * j for j in range(1, shards)], int(tolerance * total)) if total else []
    above = lambda e: (F.col("k0") > e[0]) | (F.col("k0") == e[0]) & (F.col("k1") >= e[1])
    shard = reduce(lambda a, b: a + b, (above(_edge(bits, s)).cast("int") for s in found), F.lit(0))
    # ranges of the final exchange: prefixes of the key, and of the tie too where one prefix holds far more rows than the mean
    fine = max(0, (n // range_rows).bit_length())
    short, long_ = bits[0] - min(bits[0], fine), bits[1] - min(bits[1], fine)
    coarse = F.shiftright("k0", short)
    heavy = keyed.groupBy(coarse.alias("r0")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 4 * range_rows).select("r0", F.lit(True).alias("heavy"))
    ranged = keyed.withColumns({"shard": shard, "r0": coarse}).join(heavy, "r0", "left").withColumns(
        {"r1": F.when(F.col("heavy"), F.col("k0")).otherwise(F.lit(0)), "r2": F.when(F.col("heavy"), F.shiftright("k1", long_)).otherwise(F.lit(0))}
    )
    at = ["shard", "r0", "r1", "r2"]
    counts = ranged.groupBy(*at).agg(F.count(F.lit(1)).alias("rows"))
    first = Window.partitionBy("shard").orderBy("r0", "r1", "r2").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*at, F.coalesce(F.sum("rows").over(first), F.lit(0)).alias("start"))
    placed = ranged.join(starts, at)
    slot = F.col("start") + F.row_number().over(Window.partitionBy(*at).orderBy("k0", "k1")) - 1
    return placed.withColumn("slot", slot).drop("k0", "k1", "_size", "r0", "r1", "r2", "heavy", "start")


def shard_documents(df: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law deals anew when a shard is added)."""
    text = text_of(df)
    rows = df.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"))
    out = histogram_shards(rows, F.col("key"), F.col("doc_id"), F.col("size"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 goes byte by byte and bit by bit through a list: each byte is followed by eight shift steps (-1).
SQL = """
WITH k AS (
  SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, ''))::BIGINT + 16 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(size) OVER () AS total FROM k),
s AS (
  SELECT doc_id, size, key, least((2 * below + size) * 40 // (2 * total), 39)::INTEGER AS shard,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: [('0x' || b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) AS text_crc32
  FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
