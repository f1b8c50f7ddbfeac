"""Mixing sources to target weights by iterative proportional fitting, with built-in expressions only.

Token weights are summed by cell (source, language, topic); the cells are raked to the three wanted marginals in turn
until no factor moves by more than the tolerance; a cell's calibrated weight over its own is the ratio that its documents are
sampled in proportion to, by a hash of doc_id, so a rerun picks the same ones. Cells are partial sums, so a hot source
costs one cell per language and topic.

Up to ``ROW_CELLS`` cells (counted first) lie in one row of arrays and all rounds are one aggregate over it; more cells stay a
distributed table, which a round updates by three joins with its marginal sums. Both give the same weights. A fit whose
marginals are still off their targets after the last round (targets that the cells can't meet) says so in ``converged``.

Wanted marginals come as a table per dimension, or, by ``smoothed_targets``, as the corpus's own shares to a power below
one, which lifts rare values.

Defined results: null source, language or topic count as the value '?'; a null or empty text has 0 tokens, joins its
cell and may be sampled; values without a wanted share get weight 0; repeated rows share one decision (same doc_id); a null
doc_id has one hash of its own; an empty table gives an empty result; other columns, whatever their names, are kept by
``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged, text_of

DIMENSIONS = ("source", "lang", "topic")
#: Cells that one row may hold.
ROW_CELLS = 5_000
#: A marginal share may be off its target by this part of it and still count as met.
MET = 1e-6


def token_weight(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A plain topic by marks in the text: licensed, contact, tabular or prose."""
    return F.when(text.contains("icensed under"), "licensed").when(text.contains("@"), "contact").when(text.contains(" | "), "tabular").otherwise("prose")


def _dimensions(df: DataFrame) -> dict[str, Column]:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return {"source": named("source"), "lang": named("lang"), "topic": topic_of(text_of(df))}


def with_cells(df: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of each row."""
    return df.select(F.col("doc_id").cast("long"), *(c.alias(d) for d, c in _dimensions(df).items()), token_weight(text_of(df)).alias("tokens"))


def smoothed_targets(cells: DataFrame, power: float) -> dict[str, DataFrame]:
    """For each dimension (value, share): the corpus's shares to this power, scaled to sum to 1."""
    out = {}
    for d in DIMENSIONS:
        raw = cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("w0").cast("double"), F.lit(power)).alias("raw"))
        out[d] = staged(raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("all")))).select("value", (F.col("raw") / F.greatest("all", F.lit(1e-300))).alias("share")))
    return out


def _rake_table(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float, rounds: int) -> DataFrame:
    """cells with w (weights) and moved (largest change of a factor in the last round), one staged table a round."""
    now = cells.withColumn("w", F.col("share"))
    for _ in range(rounds):
        moved = F.lit(0.0)
        for d in DIMENSIONS:
            ratio = F.coalesce(F.col("wanted"), F.lit(0.0)) / F.col("s")
            sums = now.groupBy(d).agg(F.sum("w").alias("s")).join(targets[d].select(F.col("value").alias(d), F.col("share").alias("wanted")), d, "left")
            factor = sums.select(d, F.when(F.col("s") > 0, ratio).otherwise(0.0).alias("f"), F.when(F.col("s") > 0, F.abs(ratio - 1)).otherwise(0.0).alias("off"))
            now = now.join(factor, d).withColumn("w", F.col("w") * F.col("f")).withColumn(f"off_{d}", F.col("off")).drop("f", "off")
            moved = F.greatest(moved, F.col(f"off_{d}"))
        now = staged(now.withColumn("moved", moved).drop(*(f"off_{d}" for d in DIMENSIONS)))
        most = now.agg(F.max("moved")).first()[0]
        now = now.drop("moved")
        if most is None or most <= tolerance:
            break
    return now.withColumn("moved", F.lit(most).cast("double"))


def _as_row(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """One row: per dimension its values with the wanted shares, and for each value its cells with the places of their other values."""
    row = cells.agg(F.collect_list(F.struct(*DIMENSIONS, "w0", "share")).alias("cells"))
    for d in DIMENSIONS:
        found = cells.select(d).distinct().join(targets[d].select(F.col("value").alias(d), F.col("share").alias("wanted")), d, "left")
        listed = F.array_sort(F.collect_list(F.struct(F.col(d).alias("v"), F.coalesce("wanted", F.lit(0.0)).alias("wanted"))))
        row = row.crossJoin(F.broadcast(found.agg(listed.alias(d))))
    row = row.withColumns({f"names_{d}": F.transform(d, lambda x: x["v"]) for d in DIMENSIONS})
    places = lambda c: [F.array_position(f"names_{d}", c[d]).cast("int").alias(d) for d in DIMENSIONS]
    row = row.withColumn("placed", F.transform("cells", lambda c: F.struct(*places(c), c["share"].alias("share"))))

    def cells_by(d: str) -> Column:
        return F.transform(d, lambda _, i: F.filter("placed", lambda c: c[d] == i + 1))

    return row.withColumns({f"by_{d}": cells_by(d) for d in DIMENSIONS})


def _rake_row(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float, rounds: int) -> DataFrame:
    """The same by one aggregate over the turns of all rounds. Its state is a factor per value of each dimension."""

    def turned(state: Column, d: str) -> Column:
        """The factors of d that meet its wanted shares, the others being as they are."""
        x, y = (o for o in DIMENSIONS if o != d)
        weight = lambda cells: F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["share"] * F.element_at(state[x], c[x]) * F.element_at(state[y], c[y]))
        return F.zip_with(d, F.transform(f"by_{d}", weight), lambda v, s: F.when(s > 0, v["wanted"] / s).otherwise(0.0))

    def step(state: Column, turn: Column) -> Column:
        first = F.lit(DIMENSIONS[0]) == turn["d"]
        done = state["done"] | (first & (state["moved"] <= tolerance))
        mine = lambda d: ~done & (turn["d"] == d)
        # the factors as they were, for what this turn moved
        fresh = {d: F.when(mine(d), turned(state, d)).otherwise(state[d]).alias(d) for d in DIMENSIONS}
        old = {d: F.when(mine(d), state[d]).otherwise(state[f"old_{d}"]).alias(f"old_{d}") for d in DIMENSIONS}
        apart = lambda d: F.aggregate(F.zip_with(state[d], state[f"old_{d}"], lambda a, b: F.when(b > 0, F.abs(a / b - 1)).otherwise(0.0)), F.lit(0.0), lambda m, a: F.greatest(m, a))
        moved = F.when(done | ~(turn["d"] == "check"), state["moved"]).otherwise(F.greatest(*(apart(d) for d in DIMENSIONS)))
        return F.struct(*fresh.values(), *old.values(), moved.alias("moved"), done.alias("done"))

    row = _as_row(cells, targets)
    ones = {d: F.transform(d, lambda _: F.lit(1.0)) for d in DIMENSIONS}
    start = F.struct(*(v.alias(d) for d, v in ones.items()), *(v.alias(f"old_{d}") for d, v in ones.items()), F.lit(float("inf")).alias("moved"), F.lit(False).alias("done"))
    turns = F.flatten(F.array_repeat(F.array(*(F.struct(F.lit(d).alias("d")) for d in (*DIMENSIONS, "check"))), rounds))
    fitted = row.withColumn("fit", F.aggregate(turns, start, step))
    factor = lambda d: F.element_at(F.col("fit")[d], F.array_position(f"names_{d}", F.col("c")[d]).cast("int"))
    each = fitted.select("fit", *(f"names_{d}" for d in DIMENSIONS), F.explode("cells").alias("c"))
    weight = F.col("c.share")
    for d in DIMENSIONS:
        weight = weight * factor(d)
    return each.select("c.*", weight.alias("w"), F.col("fit.moved").alias("moved"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-10, rounds: int = 200, row_cells: int = ROW_CELLS) -> DataFrame:
    """cells (source, lang, topic, w0) with w, weights whose shares meet the targets where w0 allows it, and converged; w sums to 1."""
    state = cells.agg(F.sum("w0"), F.count(F.lit(1))).first()
    shares = cells.withColumn("share", F.col("w0") / F.lit(float(state[0] or 1)))
    fit = _rake_row if state[1] <= row_cells else _rake_table
    return staged(fit(shares, targets, tolerance, rounds).withColumn("converged", F.col("moved") <= MET).drop("share", "moved"))


def uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1) by the first 52 bits of an MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def chances(cells: DataFrame, power: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    """source, lang, topic, ratio (calibrated over own weight), chance (ratio over the largest ratio), converged; one row a cell."""
    cells = staged(cells)
    raked = rake(cells, targets or smoothed_targets(cells, power))
    total = cells.agg(F.sum("w0")).first()[0] or 1
    ratios = raked.withColumn("ratio", F.when(F.col("w0") > 0, F.col("w") * F.lit(float(total)) / F.col("w0")).otherwise(1.0))
    top = ratios.agg(F.max("ratio")).first()[0] or 1.0
    return ratios.select(*DIMENSIONS, "ratio", (F.col("ratio") / F.lit(float(top))).alias("chance"), "converged")


def _cells(df: DataFrame) -> DataFrame:
    return with_cells(df).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("w0"))


def calibrated(df: DataFrame, power: float = 0.7, seed: int = 17, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per row: doc_id, source, lang, topic, tokens, ratio, probability, sampled, converged."""
    odds = chances(_cells(df), power, targets)
    drawn = with_cells(df).join(odds, list(DIMENSIONS))
    sampled = uniform(F.col("doc_id"), seed) < F.col("chance")
    return drawn.select("doc_id", *DIMENSIONS, "tokens", F.round("ratio", 6).alias("ratio"), F.round("chance", 6).alias("probability"), sampled.alias("sampled"), "converged")


def mixed(df: DataFrame, power: float = 0.95, seed: int = 17, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled rows of df, all columns kept."""
    odds = chances(_cells(df), power, targets)
    keyed = df.select(F.struct(*df.columns).alias("row"), F.struct(*(c.alias(d) for d, c in _dimensions(df).items())).alias("cell"))
    drawn = keyed.join(odds.select(F.struct(*DIMENSIONS).alias("cell"), "chance"), "cell")
    return drawn.where(uniform(F.col("row.doc_id"), seed) < F.col("chance")).select("row.*")


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
    CASE WHEN contains(coalesce(text, ''), 'icensed under') THEN 'licensed' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
      WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS w0 FROM docs GROUP BY ALL),
ts AS (SELECT source, pow(sum(w0), 0.7) AS raw FROM cells GROUP BY 1),
tl AS (SELECT lang, pow(sum(w0), 0.7) AS raw FROM cells GROUP BY 1),
tt AS (SELECT topic, pow(sum(w0), 0.7) AS raw FROM cells GROUP BY 1),
want AS (
  SELECT cells.*, ts.raw / (SELECT sum(raw) FROM ts) AS a, tl.raw / (SELECT sum(raw) FROM tl) AS b, tt.raw / (SELECT sum(raw) FROM tt) AS c
  FROM cells JOIN ts USING (source) JOIN tl USING (lang) JOIN tt USING (topic)),
fit AS (
  SELECT 0 AS k, source, lang, topic, w0, a, b, c, w0 / (SELECT sum(w0) FROM cells) AS w FROM want
  UNION ALL
  SELECT k + 1, source, lang, topic, w0, a, b, c, CASE WHEN s > 0 THEN w * c / s ELSE 0 END FROM (
    SELECT *, sum(w) OVER (PARTITION BY topic) AS s FROM (
      SELECT k, source, lang, topic, w0, a, b, c, CASE WHEN s > 0 THEN w * b / s ELSE 0 END AS w FROM (
        SELECT *, sum(w) OVER (PARTITION BY lang) AS s FROM (
          SELECT k, source, lang, topic, w0, a, b, c, CASE WHEN s > 0 THEN w * a / s ELSE 0 END AS w FROM (
            SELECT *, sum(w) OVER (PARTITION BY source) AS s FROM fit WHERE k < 200)))))),
ratios AS (SELECT source, lang, topic, CASE WHEN w0 > 0 THEN w * (SELECT sum(w0) FROM cells) / w0 ELSE 1 END AS ratio FROM fit WHERE k = 200),
odds AS (SELECT *, ratio / (SELECT max(ratio) FROM ratios) AS p FROM ratios),
met AS (
  SELECT max(greatest(abs(sa / a - 1), abs(sb / b - 1), abs(sc / c - 1))) <= 1e-6 AS converged FROM (
    SELECT a, b, c, sum(w) OVER (PARTITION BY source) AS sa, sum(w) OVER (PARTITION BY lang) AS sb, sum(w) OVER (PARTITION BY topic) AS sc FROM fit WHERE k = 200))
SELECT doc_id, source, lang, topic, tokens, round(ratio, 6) AS ratio, round(p, 6) AS probability, converged,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 13))::BIGINT / 4503599627370496.0 < p AS sampled
FROM docs JOIN odds USING (source, lang, topic), met
"""
