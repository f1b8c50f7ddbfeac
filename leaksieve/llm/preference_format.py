"""Preference formatting: the turns that chosen and rejected share become one prompt, the rest masked completions.

A pair's conversations are arrays of turns; the first place where role or text differ ends the common prefix. The
prompt is rendered once from it; each completion is rendered from its own remaining turns, with the spans (code points)
that are trained: the assistant's text and its end mark. Everything is built-in expressions; a conversation is the largest group.

Defined results: a null role is 'unknown', a null text is empty; of rows that repeat a (pair, turn) the least (role,
text) counts; turns are ordered by number, gaps don't matter; pairs that lack one side are left out; equal conversations
give empty completions; other columns are ignored; empty tables give an empty result. In ``branched``, conversations without
an id or an assistant turn give no pair, every other gives one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """key, turns: array of (turn, role, text) in order."""
    one = turns.groupBy(key, "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "t.role", "t.text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    """The turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """[start, end) of the assistant's texts with their end marks in the rendered text."""
    size = lambda t: F.length(_header(t["role"])) + F.length(t["text"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    span = lambda acc, t: F.struct((acc["at"] + F.length(_header(t["role"]))).alias("start"), (acc["at"] + size(t)).alias("end"))
    add = lambda acc, t: F.struct(
        (acc["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span(acc, t))).otherwise(acc["spans"]).alias("spans")
    )
    return F.aggregate(turns, start, add, lambda acc: acc["spans"])


def formatted(both: DataFrame) -> DataFrame:
    """(pair_id, c, r), the chosen and the rejected array of turns -> pair_id, n_common_turns, prompt, chosen, rejected and their trained spans."""
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, F.lit(False))
    common = F.when(differs > 0, differs - 1).otherwise(least).cast("int")
    cut = both.withColumn("n_common_turns", common)
    rest = lambda c: F.slice(c, F.col("n_common_turns") + 1, F.size(c))
    return cut.select(
        "pair_id",
        "n_common_turns",
        rendered(F.slice("c", F.lit(1), F.col("n_common_turns"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        rendered(rest("r")).alias("rejected"),
        trained_spans(rest("c")).alias("chosen_spans"),
        trained_spans(rest("r")).alias("rejected_spans"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Tables of (pair_id, turn, role, text), formatted."""
    return formatted(conversations(chosen, "pair_id").withColumnRenamed("turns", "c").join(conversations(rejected, "pair_id").withColumnRenamed("turns", "r"), "pair_id"))


#: Ids whose conversations may answer for each other.
BUCKET = 64


def branched(turns: DataFrame) -> DataFrame:
    """(pair_id, c, r) of every answered conversation, for want of a table of preferences.

    Chosen is the conversation up to its last assistant turn. Rejected leaves it at one of the assistant turns (by a hash of the
    id) with the last answer of the next conversation among BUCKET neighbouring ids, the last one's next being the first; a
    conversation alone there gets the first half of its own last answer.
    """
    every = conversations(turns.where(F.col("conv_id").isNotNull()), "conv_id")
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    kept = every.withColumn("places", places).where(F.size("places") > 0)
    number = F.conv(F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    last, branch = F.element_at("places", -1), F.get("places", (number % F.size("places")).cast("int"))
    kept = kept.select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), last).alias("c"), branch.alias("branch"), F.floor(F.col("conv_id") / BUCKET).alias("bucket"))
    near = Window.partitionBy("bucket").orderBy("pair_id")
    answer = F.element_at("c", -1)["text"]
    kept = kept.withColumn("answer", answer).withColumns({"next": F.lead("answer").over(near), "first": F.first("answer").over(near), "near": F.count(F.lit(1)).over(Window.partitionBy("bucket"))})
    half = F.left("answer", F.floor(F.length("answer") / 2).cast("int"))
    other = F.when(F.col("near") > 1, F.coalesce("next", "first")).otherwise(half)
    at = F.element_at("c", F.col("branch"))
    left = F.struct(at["turn"].alias("turn"), F.lit("assistant").alias("role"), other.alias("text"))
    return kept.select("pair_id", "c", F.array_append(F.slice("c", F.lit(1), F.col("branch") - 1), left).alias("r"))


def spans_text(spans: Column) -> Column:
    """start-end,start-end"""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


SQL = """
WITH o AS (SELECT conv_id, turn, min({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2),
t AS (SELECT conv_id, t.role AS role, t.text AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM o),
a AS (
  SELECT conv_id, k, text, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS n, max(k) OVER (PARTITION BY conv_id) AS last
  FROM t WHERE role = 'assistant'),
br AS (SELECT conv_id, k AS branch FROM a WHERE j = ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT % n),
fin AS (SELECT conv_id, last, text AS answer, floor(conv_id / 64) AS bucket FROM a WHERE k = last),
pairs AS (
  SELECT conv_id AS pair_id, last, branch,
    CASE WHEN count(*) OVER (PARTITION BY bucket) > 1 THEN coalesce(lead(answer) OVER b, first(answer) OVER b) ELSE left(answer, length(answer) // 2) END AS other
  FROM fin JOIN br USING (conv_id) WINDOW b AS (PARTITION BY bucket ORDER BY conv_id)),
own AS (SELECT pair_id, k, role, text AS c, CASE WHEN k < branch THEN text WHEN k = branch THEN other END AS r FROM t JOIN pairs ON t.conv_id = pairs.pair_id AND t.k <= pairs.last),
common AS (SELECT pair_id, coalesce(min(CASE WHEN r IS NULL OR c <> r THEN k END) - 1, max(k)) AS n FROM own GROUP BY 1),
parts AS (
  SELECT own.pair_id, n, k, role, '<|' || role || '|>' || chr(10) AS h, '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS tc,
    '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS tr FROM own JOIN common USING (pair_id)),
placed AS (
  SELECT *, sum(CASE WHEN k > n THEN length(tc) ELSE 0 END) OVER w AS ec, sum(CASE WHEN k > n THEN length(tr) ELSE 0 END) OVER w AS er
  FROM parts WINDOW w AS (PARTITION BY pair_id ORDER BY k))
SELECT pair_id, n::INTEGER AS n_common_turns,
  coalesce(string_agg(tc, '' ORDER BY k) FILTER (k <= n), '') AS prompt,
  coalesce(string_agg(tc, '' ORDER BY k) FILTER (k > n), '') AS chosen,
  coalesce(string_agg(tr, '' ORDER BY k) FILTER (k > n), '') AS rejected,
  coalesce(string_agg((ec - length(tc) + length(h))::BIGINT || '-' || ec::BIGINT, ',' ORDER BY k) FILTER (k > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((er - length(tr) + length(h))::BIGINT || '-' || er::BIGINT, ',' ORDER BY k) FILTER (k > n AND role = 'assistant' AND tr IS NOT NULL), '') AS rejected_spans
FROM placed GROUP BY pair_id, n
"""
