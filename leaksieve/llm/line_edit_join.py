"""Line dedup by a segment-partition edit join, with built-in expressions only.

Two distinct lines are linked if they are few edits apart: two from 24 characters on, one from 12 on, none below (the shorter
of the two lines decides). Links make classes, equal lines are one class from the start, and of each class only
the line that comes first (by doc_id, then place) stays; links chain, so a removed line may be more than two edits from it. A line is split into edits + 1 segments: a line within the threshold
must contain one of them unchanged, at a place and in a length that the edits left and right of it allow. So each
line enters the buckets of its segments (index) and of the substrings that could be another line's segment (probes, for each
length from its own down to ``edits`` less).

A bucket's lines are compared with one of them first, which settles nearly all of a hot bucket without listing its
pairs. A bucket that still holds lines of different classes is listed if it has few pairs; otherwise its lines drop the
segment that they share and the rest, which must be as few edits apart, is segmented again within the bucket. This
goes on until every bucket has few pairs or a rest too short to split, so no link is lost and no hot template is squared.
Unchanged parts and counts of letters settle most pairs; the others are verified by a banded bit-parallel distance.

Defined results: white space around a line doesn't count; blank lines are never linked or removed; lines shorter than
``min_chars`` are linked but stay; a null text has no lines; rows with a null doc_id are left alone; rows that repeat a
doc_id and text are one document and lose the same lines, while different texts under one doc_id are different
documents; an empty table gives an empty result; other columns, whatever their names, are kept by ``without_repeated_lines``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.components import connected
from leaksieve.llm.edit_distance import let, within
from leaksieve.llm.tables import staged, text_of

#: Least length of a line for each number of edits.
LEAST = {1: 12, 2: 24}
#: Pairs of a bucket that are listed (some seconds of a task); a bucket with more is split by its lines' rests.
PAIRS = 1_000_000
#: Disjoint classes of characters whose counts are compared before a distance is taken.
COUNTED = ("e", "a", "i", "o", "n", "rR", "tT", "hH", "dlDL", "s", r"\s")


def lines(df: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the whole text), line (from 0), text of every line of the documents with an id."""
    rows = df.select(F.col("doc_id").cast("long"), text_of(df).alias("text")).where(F.col("doc_id").isNotNull())
    # outer generators: the optimiser would copy the input of an inner one into a filter
    each = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "text"))
    return each.withColumn("text", F.btrim("text", F.lit(" \t\r")))


def _windows(edits: int, delta: int) -> list[tuple[int, int]]:
    """(segment, shift): where a line that is delta longer may hold the segment, seen from the left and from the right."""
    out = []
    for i in range(edits + 1):
        low, high = max(-i, delta - (edits - i)), min(i, delta + edits - i)
        out += [(i, s) for s in range(low, high + 1)]
    return out


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of the even parts of a string of length n."""
    start = F.floor(n * i / parts).cast("int")
    return start, F.floor(n * (i + 1) / parts).cast("int") - start


def _key(bucket: Column, m: Column, i: int, text: Column, start: Column, length: Column) -> Column:
    return F.xxhash64(bucket, m, F.lit(i), F.substring(text, start + 1, length))


def _index(bucket: Column, text: Column, n: Column, edits: int) -> list[tuple[Column, Column, Column]]:
    """(key, start, length) of a string's own segments."""
    places = [_segment(n, i, edits + 1) for i in range(edits + 1)]
    return [(_key(bucket, n, i, text, *at), *at) for i, at in enumerate(places)]


def _probes(bucket: Column, text: Column, n: Column, edits: int, delta: int, own: bool = True) -> list[tuple[Column, Column, Column]]:
    """(key, start, length) of what could be segments of strings that are delta shorter; own: those that are its index entries as well."""
    out = []
    for i, shift in _windows(edits, delta):
        if delta == shift == 0 and not own:
            continue
        start, length = _segment(n - delta, i, edits + 1)
        out.append((_key(bucket, n - delta, i, text, start + shift, length), start + shift, length))
    return out


def with_keys(texts: DataFrame) -> DataFrame:
    """texts with own, the keys of the index entries of text, and seen, those of its other probes; null below the least length."""
    zero, text, n = F.lit(0).cast("long"), F.col("text"), F.col("chars")

    def probes(edits: int, deltas: range) -> Column:
        return F.array(*(k for d in deltas for k, *_ in _probes(zero, text, n, edits, d, own=False)))

    own = {e: F.array(*(k for k, *_ in _index(zero, text, n, e))) for e in LEAST}
    seen = {e: probes(e, range(e + 1)) for e in LEAST}
    # a line of just the least length for two edits may also be one edit from a shorter one
    edge = F.concat(seen[2], probes(1, range(1, 2)))
    long, some = n >= LEAST[2], n >= LEAST[1]
    keys = {"own": F.when(long, own[2]).when(some, own[1]), "seen": F.when(n > LEAST[2], seen[2]).when(long, edge).when(some, seen[1])}
    return texts.withColumn("chars", F.length("text")).withColumns(keys)


def _letters(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(f"[{c}]")) for c in COUNTED]


def _allowed(n: Column) -> Column:
    """Edits that lines of this length allow."""
    return F.when(n >= LEAST[2], 2).when(n >= LEAST[1], 1).otherwise(0)


def _intact(a: Column, b: Column, edits: int, parts: int) -> Column:
    """How many of the even parts of a occur unchanged in b, at most ``edits`` places off; each edit spoils one part."""
    n = F.length(a)
    found = F.lit(0)
    for i in range(parts):
        start, length = _segment(n, i, parts)
        low = F.greatest(start - edits, F.lit(0))
        around = F.substring(b, low + 1, start + length + edits - low)
        found = found + F.contains(around, F.substring(a, start + 1, length)).cast("int")
    return found


def near(a: Column, b: Column, letters_a: Column, letters_b: Column) -> Column:
    """Whether two lines are as few edits apart as the shorter one allows. An edit moves at most two counts by one."""
    edits = _allowed(F.least(F.length(a), F.length(b)))

    def judged(x: Column) -> Column:
        ta, tb, edits = x["a"], x["b"], x["edits"]
        apart = F.aggregate(F.zip_with(x["la"], x["lb"], lambda p, q: F.abs(p - q)), F.lit(0), lambda s, p: s + p)
        whole = F.when(edits == 2, _intact(ta, tb, 2, 6) >= 4).otherwise(_intact(ta, tb, 1, 4) >= 3)
        exact = F.when(edits == 2, within(ta, tb, 2)).when(edits == 1, within(ta, tb, 1)).otherwise(False)
        return F.when(apart > 2 * edits, False).when(whole, exact).otherwise(False)

    # a lambda's body isn't compiled into the join, whose method would grow too large for the JVM to optimise
    pair = F.struct(a.alias("a"), b.alias("b"), letters_a.alias("la"), letters_b.alias("lb"), edits.alias("edits"))
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, let(pair, judged)).otherwise(False)


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts are near; known (id, text, letters)."""
    side = lambda c: known.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"), F.col("letters").alias(f"l{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(near(F.col("ta"), F.col("tb"), F.col("la"), F.col("lb"))).select("a", "b")


_ENTRY = "key", "is_index", "start", "length", "delta"


def _members(left: DataFrame) -> DataFrame:
    """Entries of (id, rest, bucket, edits, delta): index entries where delta is null or 0, probes where it is null or given.

    delta: how much longer the line is than those it looks for in this bucket; null where that isn't known yet.
    """
    bucket, text, n = F.col("bucket"), F.col("rest"), F.col("n")

    def entries(edits: int) -> Column:
        entry = lambda k, index, d: F.struct(k[0].alias("key"), F.lit(index).alias("is_index"), k[1].alias("start"), k[2].alias("length"), F.lit(d).alias("delta"))
        own = F.array(*(entry(k, True, 0) for k in _index(bucket, text, n, edits)))
        probes = {d: F.array(*(entry(k, False, d) for k in _probes(bucket, text, n, edits, d))) for d in range(edits + 1)}
        first = F.concat(own, *probes.values())
        later = F.lit(None)
        for d, p in probes.items():
            later = F.when(F.col("delta") == d, p).otherwise(later)
        return F.when(F.col("delta").isNull(), first).when(F.col("was_index"), own).otherwise(later)

    every = F.when(F.col("edits") == 2, entries(2)).otherwise(entries(1))
    keyed = left.withColumn("n", F.length("rest")).select("id", "edits", "rest", F.explode_outer(every).alias("e"))
    return keyed.select("id", "edits", "rest", *(F.col(f"e.{c}").alias(c) for c in _ENTRY)).where(F.col("key").isNotNull())


def _cross_links(left: DataFrame, known: DataFrame, pairs_listed: int = PAIRS) -> DataFrame:
    """Links between different classes among (id, label). known (id, text, letters).

    Every pair that shares a bucket and isn't of one class is compared, in the bucket or in one of those that it is split into.
    """
    first = left.join(known.select("id", F.col("text").alias("rest")), "id").withColumns({"bucket": F.lit(0).cast("long"), "delta": F.lit(None).cast("int"), "was_index": F.lit(False)})
    # a line of 24 characters or more also meets shorter ones, at one edit
    two = first.where(F.length("rest") >= LEAST[2]).withColumn("edits", F.lit(2))
    one = first.where(F.length("rest") <= LEAST[2]).withColumn("edits", F.lit(1))
    now, labels, links = two.unionByName(one), left.select("id", "label"), None
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        members = staged(_members(now).join(labels, "id"))
        counts = F.count_if("is_index").alias("i"), F.count_if(~F.col("is_index")).alias("p"), F.min(F.length("rest") - F.col("length")).alias("rest")
        held = members.groupBy("key").agg(*counts, F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.when(F.col("is_index"), F.col("id"))).alias("pivot"))
        torn = staged(held.where((F.col("i") > 0) & (F.col("p") > 0) & (F.col("l0") != F.col("l1"))))
        small = (F.col("i") * F.col("p") <= pairs_listed) | (F.col("rest") <= max(LEAST))
        # dealt out by hand: these rows are few, their pairs aren't
        listed = members.join(torn.where(small).select("key"), "key").join(known, "id").repartition(tasks, "key")
        side = lambda s, listed=listed: listed.select(*(F.col(c).alias(c + s) for c in ("key", "id", "label", "text", "letters", "is_index")))
        x, y = side("x").where("is_indexx"), side("y").where("not is_indexy")
        alike = F.when(F.col("labelx") != F.col("labely"), near(F.col("textx"), F.col("texty"), F.col("lettersx"), F.col("lettersy"))).otherwise(False)
        found = staged(x.join(y, (F.col("keyx") == F.col("keyy")) & alike).select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct())
        links = found if links is None else links.unionByName(found)
        hot = torn.where(~small)
        if hot.isEmpty():
            return links
        crowd = staged(members.join(hot.select("key", "pivot"), "key"))
        star = crowd.where(F.col("id") != F.col("pivot")).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
        links = staged(links.unionByName(_verified(star, known)))
        classes = connected(links.unionByName(labels.where(F.col("id") != F.col("label")).select(F.col("id").alias("a"), F.col("label").alias("b"))))
        labels = staged(labels.select("id").join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label")))
        rest = F.concat(F.substring("rest", F.lit(1), F.col("start")), F.substring(F.col("rest"), F.col("start") + F.col("length") + 1, F.length("rest")))
        now = crowd.select("id", "edits", F.col("key").alias("bucket"), rest.alias("rest"), "delta", F.col("is_index").alias("was_index")).distinct()


def edit_links(keyed: DataFrame, texts_of: Callable[[DataFrame], DataFrame], pairs_listed: int = PAIRS) -> DataFrame:
    """(id, id2, own, seen), one or more rows per line -> (id, id2, label): classes of the lines that are linked to another one.

    id and id2 are two hashes of the line; texts_of gives (id, id2, text) of a table of ids, one row each. Should two different
    lines share id, the one with the lesser id2 stands for it and the other is left unlinked: nothing is removed for a line
    that it isn't near to.
    """
    keyed = keyed.where(F.col("own").isNotNull())
    pivots = keyed.select("id", F.explode_outer("own").alias("key")).groupBy("key").agg(F.min("id").alias("pivot"))
    entries = keyed.select("id", F.explode_outer(F.concat("own", "seen")).alias("key"))
    crowded = staged(entries.join(pivots.hint("shuffle_hash"), "key").where(F.col("id") != F.col("pivot")).select("key", "id", "pivot").distinct())
    everyone = staged(crowded.select("id").union(crowded.select("pivot")).distinct())
    known = staged(texts_of(everyone).withColumn("letters", F.array(*_letters(F.col("text")))))
    bare = known.drop("id2")
    star = staged(_verified(crowded.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), bare))
    labels = connected(star).withColumnRenamed("node", "id")
    named = crowded.select("key", "id").union(crowded.select("key", F.col("pivot").alias("id"))).distinct().join(labels, "id", "left")
    named = named.withColumn("label", F.coalesce("label", "id"))
    torn = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).where((F.col("l0") != F.col("l1")) & (F.col("n") > 2)).select("key")
    left = staged(named.join(torn, "key").select("id", "label").distinct())
    classes = connected(star.unionByName(_cross_links(left, bare, pairs_listed))).withColumnRenamed("node", "id")
    return staged(classes.join(known.select("id", "id2"), "id").select("id", "id2", "label"))


def line_classes(df: DataFrame) -> DataFrame:
    """doc_id, mark, line, chars, class_id, first_doc, first_line, near, later, others: every line that shares its class.

    first_doc and first_line: the line that stays for the class; near: its text differs from this line's; later: this isn't that
    line; others: lines of the class besides this one (those of repeated rows count each).
    """
    every = lines(df).where(F.col("text") != "")
    ids = {"id": F.xxhash64("text"), "id2": F.xxhash64(F.lit(1), F.col("text"))}
    table = staged(with_keys(every).withColumns(ids).drop("text"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """Texts of some ids, split out of one document each."""
        place = F.min(F.struct("id2", "doc_id", "mark", "line")).alias("at")
        places = staged(table.join(wanted, "id", "left_semi").groupBy("id").agg(place).select("id", "at.*"))
        some = staged(places.select("doc_id").distinct())
        return lines(df.join(some, "doc_id", "left_semi")).join(places, ["doc_id", "mark", "line"]).dropDuplicates(["id"]).select("id", "id2", "text")

    placed = table.select("doc_id", "mark", "line", "chars", *ids)
    place = F.xxhash64("doc_id", "mark", "line")
    distinct_lines = placed.groupBy(*ids).agg((F.min(place) != F.max(place)).alias("repeated"))
    labels = edit_links(table.select(*ids, "own", "seen"), texts_of)
    mine = distinct_lines.join(labels, ["id", "id2"], "left").where(F.col("label").isNotNull() | F.col("repeated"))
    # lines that only repeat are told apart by both hashes
    mine = staged(mine.select("id", "id2", F.coalesce("label", "id").alias("class_id"), F.when(F.col("label").isNull(), F.col("id2")).otherwise(0).alias("own")))
    found = staged(placed.join(mine, ["id", "id2"]))
    at = F.struct("doc_id", "mark", "line", "id", "id2")
    # written before the join: a hot class's lines can then be split over tasks, which Spark does where both sides are plain exchanges
    heads = staged(found.groupBy("class_id", "own").agg(F.min(at).alias("head"), (F.count(F.lit(1)) - 1).alias("others")))
    both = found.join(heads, ["class_id", "own"])
    later = F.struct("doc_id", "mark", "line") != F.struct("head.doc_id", "head.mark", "head.line")
    differs = F.struct("id", "id2") != F.struct("head.id", "head.id2")
    shown = both.select("doc_id", "mark", "line", "chars", "class_id", F.col("head.doc_id").alias("first_doc"), F.col("head.line").alias("first_line"), differs.alias("near"), later.alias("later"), "others")
    return shown.distinct()


_LINKED = "struct<line:int,class_id:bigint,first_doc:bigint,first_line:int,near:boolean,removed:boolean,others:bigint>"


def _per_document(df: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, mark and a document's linked lines in one array (bounded by its lines)."""
    removed = (F.col("later") & (F.col("chars") >= min_chars)).alias("removed")
    entry = F.struct("line", "class_id", "first_doc", "first_line", "near", removed, "others")
    return line_classes(df).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(entry)).alias("linked"))


def line_report(df: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per row: doc_id, n_lines, n_linked, n_removed, n_near, n_links and the linked lines with their class ids.

    n_linked: lines that share a class; n_near: removed lines whose text differs from the line that stays; n_links: other
    lines that its lines are linked to by their classes.
    """
    counted = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split(text_of(df), "\n", -1))).cast("long")
    base = df.select(F.col("doc_id").cast("long"), F.xxhash64(text_of(df)).alias("mark"), counted.alias("n_lines"))
    linked = F.coalesce("linked", F.array().cast(f"array<{_LINKED}>"))
    many = lambda test: F.size(F.filter("linked", test)).cast("long")
    out = base.join(_per_document(df, min_chars), ["doc_id", "mark"], "left").select("doc_id", "n_lines", linked.alias("linked"))
    counts = {"n_linked": F.size("linked").cast("long"), "n_removed": many(lambda x: x["removed"]), "n_near": many(lambda x: x["removed"] & x["near"]), "n_links": F.aggregate("linked", F.lit(0).cast("long"), lambda s, x: s + x["others"])}
    return out.select("doc_id", "n_lines", *(c.alias(k) for k, c in counts.items()), "linked")


def without_repeated_lines(df: DataFrame, min_chars: int = 10) -> DataFrame:
    """df with the removed lines gone from text; other columns as they are, n_chars (where there is one) counted anew."""
    gone = F.transform(F.filter("linked", lambda x: x["removed"]), lambda x: x["line"])
    removed = _per_document(df, min_chars).select("doc_id", "mark", gone.alias("gone")).where(F.size("gone") > 0)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(df)).alias("mark"))
    kept = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    out = rows.join(removed, ["doc_id", "mark"], "left").withColumn("kept", text)
    new = {"text": F.col("kept")}
    if "n_chars" in df.columns:
        changed = F.length("kept").cast(dict(df.dtypes)["n_chars"])
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(changed)
    return out.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in df.columns))
