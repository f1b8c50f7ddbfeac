"""BagMinHash near-duplicates over multisets of five-word shingles.

Each shingle's multiplicity is its weight. Weights are discretised at whole numbers; the levels [0,1), [1,2), [2,4), [4,8)..
form a hierarchy of independent Poisson processes per shingle, each point carrying a time, a signature slot and a
level. A text keeps, per slot, the earliest point whose level lies below its weight, so two signatures agree in a slot with
probability equal to the weighted Jaccard similarity. A process stops as soon as its times pass the largest kept one.

Texts with equal words are one class from the start. Bands of the signature make candidates; in each bucket the members
are compared with the member that shares most buckets (multiset overlap of all shingles, exactly), and links make classes.
Of members of different classes that still share a bucket, those pairs are compared whose whole signatures agree in as many
slots as all but about one in 30,000 pairs at the threshold do. A pair that shares several buckets is listed once.

Defined results: a null text is empty; texts without words are equal to each other; a text of one to four words has one
shingle, all its words; a row with a null doc_id is a class of its own; repeated rows fall in one class and stay or go
together; different texts under one doc_id are different documents (the class is named by the least doc_id, and of its rows
under that doc_id the one with the least text hash stays); other columns are kept by ``without_near_duplicates``; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.components import connected
from leaksieve.llm.tables import staged, text_of

BANDS, ROWS = 30, 5
SLOTS = BANDS * ROWS
#: Slots, one byte each, in words of seven (sums of an eighth would overflow a signed word).
WORDS = -(-SLOTS // 7)
#: Cells of a shingle profile: the sum of the smaller counts of two profiles is at least their overlap.
PROFILE = 256
#: Shingles whose signatures are computed together.
CHUNK = 200_000
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def _step(n: int) -> np.uint64:
    """n times the golden ratio's 64 bits."""
    return _U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


def shingles(text: str, hashes: WordHashes, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and the sorted distinct shingles with their counts."""
    words = text.lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    if not len(w):
        return w, w, w.astype(np.int64)
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, _U)
    for i in range(k):
        h = mix(h + w[i : len(w) - k + 1 + i])
    distinct, counts = np.unique(h, return_counts=True)
    return w, distinct, counts


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x SLOTS matrix of the earliest times; inf where an owner has no element."""
    best = np.full(n * SLOTS, np.inf)
    top = int(weights.max()).bit_length() if len(weights) else 0
    key, low, width, limit, own = [], [], [], [], []
    for level in range(top + 1):  # levels [0,1), [1,2), [2,4)..
        start = 0 if level == 0 else 1 << (level - 1)
        has = np.flatnonzero(weights > start)
        if not len(has):
            break
        key.append(mix(elements[has] + _step(level + 1)))
        low.append(np.full(len(has), float(start)))
        width.append(np.full(len(has), float(max(1, start))))
        limit.append(weights[has].astype(float))
        own.append(owner[has])
    if not key:
        return best.reshape(n, SLOTS)
    key, low, width, limit, own = map(np.concatenate, (key, low, width, limit, own))
    time, step = np.zeros(len(key)), 0
    scale = 1.0 / (1 << 53)
    while len(key):
        step += 1
        draw = mix(key + _step(step))
        time = time - np.log1p(-((draw >> _U(11)).astype(np.float64) * scale)) / width
        worst = best.reshape(n, SLOTS).max(axis=1)
        alive = time < worst[own]
        key, time, low, width, limit, own, draw = (a[alive] for a in (key, time, low, width, limit, own, draw))
        other = mix(draw + _GOLD)
        slot = (other >> _U(32)) % _U(SLOTS)
        hit = low + (other & _U(0xFFFFFFFF)).astype(np.float64) / 4294967296.0 * width < limit
        np.minimum.at(best, own[hit] * SLOTS + slot[hit].astype(np.int64), time[hit])
    return best.reshape(n, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS keys."""
    bits = np.ascontiguousarray(signature).view(_U).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _GOLD, bits.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + bits[:, :, r])
    return key.view(np.int64)


def content(words: np.ndarray) -> tuple[int, int]:
    """Two hashes of the sequence of words."""
    place = np.arange(1, len(words) + 1, dtype=_U) * _GOLD
    return int(mix(words + place).sum().astype(np.int64)), int(mix(words ^ (place * place)).sum().astype(np.int64))


def slot_bytes(signature: np.ndarray) -> np.ndarray:
    """n x WORDS words: a byte of each slot's hash."""
    out = np.zeros((len(signature), WORDS, 8), np.uint8)
    bits = (mix(np.ascontiguousarray(signature).view(_U).reshape(-1, SLOTS)) >> _U(56)).astype(np.uint8)
    out[:, :, :7] = np.pad(bits, ((0, 0), (0, 7 * WORDS - SLOTS))).reshape(-1, WORDS, 7)
    return out.reshape(-1, 8 * WORDS).view("<i8")


_SIGNED = "doc_id long, mark long, h1 long, h2 long, n long, bands array<long>, slots array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def out(rows: list) -> pa.RecordBatch:
        sizes = [len(r[3]) for r in rows]
        sig = signatures(np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows]), np.repeat(np.arange(len(rows)), sizes), len(rows))
        keys = [k if s else [] for k, s in zip(band_keys(sig), sizes, strict=True)]
        whole = [content(r[2]) for r in rows]
        longs = [[r[0] for r in rows], [r[1] for r in rows], [x[0] for x in whole], [x[1] for x in whole], [int(r[4].sum()) for r in rows]]
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), pa.array(keys, lists), pa.array(list(slot_bytes(sig)), lists)], names=["doc_id", "mark", "h1", "h2", "n", "bands", "slots"])

    for batch in batches:
        rows, held = [], 0
        for doc_id, mark, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
            w, e, c = shingles(text, hashes)
            rows.append((doc_id, mark, w, e, c))
            held += len(e) + 100
            if held > CHUNK:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [shingles(t, hashes) for t in batch["text"].to_pylist()]
        h1 = [content(w)[0] for w, *_ in found]
        profiles = [np.bincount((e % _U(PROFILE)).astype(np.int64), weights=c, minlength=PROFILE).astype(np.int32) for _, e, c in found]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(h1, pa.int64()), pa.array([np.repeat(e, c).tobytes() for _, e, c in found], pa.binary()), pa.array(profiles, pa.list_(pa.int32()))], names=["doc_id", "h1", "bag", "profile"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    return int(np.minimum(n[same], m[at[same]]).sum())


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch["bag_a"], batch["bag_b"], strict=True):
                x, y = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                shared = overlap(x, y)
                good.append(shared >= threshold * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _linked(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) with multiset overlap over union at the threshold or above."""
    a, b = bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    return staged(pairs.join(a, "a").join(b, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(_verify(threshold), "a long, b long"))


def _alike(threshold: float):
    return F.least("na", "nb") >= threshold * F.greatest("na", "nb")


def _classed(df: DataFrame, threshold: float) -> DataFrame:
    """doc_id, mark (a hash of the text), class_id, n_shingles, stays; one row per row."""
    texts = df.select(F.col("doc_id").cast("long"), text_of(df).alias("text"))
    signed = staged(texts.withColumn("mark", F.xxhash64("text")).mapInArrow(_sign, _SIGNED))
    known, same = signed.where(F.col("doc_id").isNotNull()), ["h1", "h2", "n"]
    copies = known.groupBy(*same).agg(F.min(F.struct("doc_id", "mark")).alias("least"))
    # a text is named by the least doc_id that has it, or by its hashes where that names another text already
    owner = copies.groupBy("least.doc_id").agg(F.min(F.struct("h1", "h2")).alias("owner"))
    hashes = F.struct("h1", "h2")
    named = copies.withColumn("doc_id", F.col("least.doc_id")).join(owner, "doc_id").withColumn("id", F.when(hashes == F.col("owner"), F.col("doc_id")).otherwise(F.xxhash64(*same, "doc_id")))
    named = staged(named.select(*same, "least", "id"))  # a plain exchange, so that the copies of a hot text can be split over tasks
    member = staged(known.select("doc_id", "mark", *same).join(named.select(*same, "least", "id"), same))
    first = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))
    reps = staged(member.where(first).select("doc_id", "mark", "h1", "n", "id", "least").dropDuplicates(["id"]))
    signs = staged(signed.select("doc_id", "mark", "bands", "slots").join(reps.drop("least"), ["doc_id", "mark"]).dropDuplicates(["id"]))
    links = _links(texts, signs, threshold)
    labels = connected(links)
    groups = labels.join(reps.select(F.col("id").alias("node"), "least"), "node").groupBy("label").agg(F.min("least").alias("head"))
    heads = staged(labels.join(groups, "label").select(F.col("node").alias("id"), "head"))
    out = member.join(heads, "id", "left").withColumn("head", F.coalesce("head", "least"))
    stays = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))
    classed = out.select("doc_id", "mark", F.col("head.doc_id").alias("class_id"), F.col("n").alias("n_shingles"), stays.alias("stays"))
    lone = signed.where(F.col("doc_id").isNull()).select("doc_id", "mark", F.lit(None).cast("long").alias("class_id"), F.col("n").alias("n_shingles"), F.lit(True).alias("stays"))
    return classed.unionByName(lone)


def _links(texts: DataFrame, signs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of ids: links that give the classes. signs: doc_id, mark, h1, n, id, bands and slots of every different text."""
    entries = signs.select("id", "n", F.explode_outer("bands").alias("key")).where(F.col("key").isNotNull()).distinct()
    held = entries.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1)
    crowded = staged(entries.join(held, "key"))
    score = crowded.groupBy("id").agg(F.sum("held").alias("score"))
    pivots = crowded.join(score, "id").groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"), "n")).alias("top")).select("key", (-F.col("top.minus")).alias("b"), F.col("top.n").alias("nb"))
    star = crowded.join(pivots, "key").select(F.col("id").alias("a"), F.col("n").alias("na"), "b", "nb").where(F.col("a") != F.col("b")).where(_alike(threshold))
    star = staged(star.select("a", "b").distinct())
    links = _linked(star, _bags(texts, _named(signs, star.select(F.col("a").alias("id")).union(star.select("b")))), threshold)
    return links.unionByName(_across(texts, signs, crowded, links, threshold))


def _named(signs: DataFrame, ids: DataFrame) -> DataFrame:
    return staged(signs.join(ids.distinct(), "id", "left_semi").select("id", "doc_id", "h1"))


def _bags(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, multiset and profile of the wanted (id, doc_id, h1)."""
    bags = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_multisets, "doc_id long, h1 long, bag binary, profile array<int>")
    return staged(bags.join(wanted, ["doc_id", "h1"]).select("id", "bag", "profile").dropDuplicates(["id"]))


def least_agreement(threshold: float) -> int:
    """Equal slots that a pair at the threshold falls short of with a probability of about 3e-5 (four deviations)."""
    return math.floor(SLOTS * threshold - 4 * math.sqrt(SLOTS * threshold * (1 - threshold)))


def agreement(a: str, b: str):
    """Equal bytes of two arrays of words, a word at a time: a byte is zero where neither it nor its low seven bits plus 127 carry."""
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)

    def different(k: int):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        return F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high))

    return F.lit(SLOTS) - sum((different(k) for k in range(WORDS)), F.lit(0))


def _across(texts: DataFrame, signs: DataFrame, crowded: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Links between different classes that share a bucket.

    The join tests a pair before it becomes a row: by its lengths, by its signatures, whether this is the first bucket that it
    shares, and by what the overlap can be at most.
    """
    labels = connected(links)
    named = crowded.select("key", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    torn = named.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("l0"), F.max("label").alias("l1")).where((F.col("l0") != F.col("l1")) & (F.col("held") > 2)).select("key")
    named = staged(named.join(torn, "key"))
    keys = named.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    bags = _bags(texts, _named(signs, named.select("id")))
    left = named.join(keys.join(signs.select("id", "slots"), "id").join(bags.select("id", "profile"), "id"), "id")
    side = lambda s: left.select(*(F.col(c).alias(t + s) for c, t in (("key", "k"), ("id", ""), ("n", "n"), ("label", "l"), ("keys", "all"), ("slots", "s"), ("profile", "p"))))
    near = F.when((F.col("la") > F.col("lb")) & _alike(threshold), agreement("sa", "sb") >= least_agreement(threshold)).otherwise(False)
    once = F.when(near, F.get(F.array_intersect("alla", "allb"), F.lit(0)) == F.col("ka")).otherwise(False)
    most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    enough = F.when(once, most >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6).otherwise(False)
    pairs = side("a").join(side("b"), (F.col("ka") == F.col("kb")) & enough).select("a", "b")
    return _linked(staged(pairs), bags, threshold)


def near_duplicates(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row: doc_id, class_id (the least doc_id of the class), n_shingles, stays (it is the class's first document)."""
    return _classed(df, threshold).select("doc_id", "class_id", "n_shingles", "stays")


def without_near_duplicates(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of df whose document stays: one of each class (every row of it), and rows without an id."""
    gone = staged(_classed(df, threshold).where(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct())
    rows = df.select(F.struct(*df.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of(df)).alias("mark"))
    return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left_anti").select("row.*")
