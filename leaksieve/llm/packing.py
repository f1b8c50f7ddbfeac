"""Best-fit packing with swap-based local search.

Documents become token ids (plus an end id), only those above the sequence length are cut, and the pieces go into
sequences: best fit decreasing inside blocks of pieces, then a local search over the underfull sequences (move a
document, exchange one for one, exchange two for one) where each step raises the sum of squared fills, until sequences
empty. The emptiest sequences of all blocks then meet in fewer blocks, round after round, until one block is left, so
nothing whole passes through one task.

Defined results: a null text is empty and gives one piece holding just the end id; repeated rows each give their
pieces; a null doc_id is carried through; other columns are ignored; an empty table gives an empty result. Pieces of equal
length are told apart by doc_id, piece and checksum.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged, text_of, tokenizer_path

#: Pieces of a block of the first round (mean), sequences that a block passes on, and blocks that meet in one.
BLOCK_PIECES, PASSED_ON, FAN_IN = 40_000, 48, 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer: str):
    """text -> numpy ids equal to the tokenizer file's: its vocabulary as ranks is quicker; special strings need the file itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path(tokenizer))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(tokenizer_path(tokenizer.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(quick.encode_ordinary(text), np.uint32)

    return encode


def _cut(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + capacity if k else first]
                    for column, value in zip(out, (doc_id, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each document, cut only where they exceed a sequence."""
    return df.select(F.col("doc_id").cast("long"), text_of(df).alias("text")).mapInArrow(_cut(tokenizer, capacity, end_id), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest sequence that has room. Returns the indices in each sequence."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Move, one-for-one and two-for-one exchanges out of the emptiest sequences; each raises the squared fill.

    A pass takes each underfull sequence, emptiest first, through steps until it is empty or stuck. The search ends when
    the number of sequences meets its lower bound or a whole pass has emptied none.
    """
    least = -(-int(lengths.sum()) // capacity) if len(lengths) else 0
    bins = [list(b) for b in bins if b]
    fill = [int(lengths[b].sum()) for b in bins]
    emptied, left = True, len(bins)
    while emptied and left > least:
        emptied = False
        for source in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b]):
            while 0 < fill[source] < capacity and _step(bins, fill, lengths, capacity, source):
                pass
            if not fill[source]:
                emptied, left = True, left - 1
                if left == least:
                    break
    return [b for b in bins if b]


def _step(bins, fill, lengths, capacity, source) -> bool:
    """One improving step that takes tokens from source into a sequence at least as full; False if there is none."""
    target = np.array([b for b in range(len(bins)) if b != source and fill[source] <= fill[b] < capacity], np.int64)
    if not len(target):
        return False
    room = capacity - np.array([fill[b] for b in target])
    items = sorted(bins[source], key=lambda i: -lengths[i])
    for i in items:  # move: the tightest room that holds it
        fits = np.flatnonzero(room >= lengths[i])
        if len(fits):
            return _shift(bins, fill, lengths, source, [i], int(target[fits[np.argmin(room[fits])]]), [])
    where = np.repeat(target, [len(bins[b]) for b in target])
    members = np.array([j for b in target for j in bins[b]], np.int64)
    sizes, rooms = lengths[members], np.repeat(room, [len(bins[b]) for b in target])
    pairs = [[i] for i in items] + [[i, j] for k, i in enumerate(items) for j in items[k + 1 :]]
    for out in pairs:  # one for one, then two for one: the exchange that fills a sequence most
        gain = int(lengths[out].sum()) - sizes
        good = np.flatnonzero((gain > 0) & (gain <= rooms))
        if len(good):
            k = good[np.argmin(rooms[good] - gain[good])]
            return _shift(bins, fill, lengths, source, out, int(where[k]), [int(members[k])])
    return False


def _shift(bins, fill, lengths, source, out, target, back) -> bool:
    for i in out:
        bins[source].remove(i)
        bins[target].append(i)
    for i in back:
        bins[target].remove(i)
        bins[source].append(i)
    moved = int(lengths[out].sum()) - int(lengths[back].sum() if back else 0)
    fill[source] -= moved
    fill[target] += moved
    return True


def _pack_block(capacity: int, passed_on: int, again: bool):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        if again:
            old = rows.groupby("sequence_id", sort=True).indices
            bins = min((local_search(b, lengths, capacity) for b in ([list(v) for v in old.values()], best_fit(lengths, capacity))), key=len)
        else:
            bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        bins.sort(key=lambda b: int(lengths[b].sum()))
        sequence, offset, passed = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for n, b in enumerate(bins):
            sequence[b], offset[b] = n, np.cumsum(lengths[b]) - lengths[b]
            passed[b] = n < passed_on and int(lengths[b].sum()) < capacity
        return rows.assign(sequence_id=(int(key[0]) << 24) + sequence, offset=offset, passed=passed)

    return run


def pack(pieces: DataFrame, capacity: int = 2048, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, start, length, ids_crc32 (no length above capacity)."""
    pieces = staged(pieces)
    n = pieces.where(F.col("length") < capacity).count()
    blocks = max(1, -(-n // block_pieces))
    schema = f"{PIECES}, block long, sequence_id long, offset long, passed boolean"
    full = pieces.where(F.col("length") >= capacity).withColumns(
        {
            "sequence_id": -F.monotonically_increasing_id() - 1,
            "offset": F.lit(0).cast("long"),
        }
    )
    # a row's place in the written table salts the block, so repeats of one row are spread as well
    dealt = pieces.withColumn("at", F.monotonically_increasing_id()).where(F.col("length") < capacity).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "at"), F.lit(blocks)).cast("long")).drop("at")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    now, first = dealt.groupBy("block").applyInPandas(_pack_block(capacity, PASSED_ON, False), schema), 0
    done = [full.select(*columns)]
    while True:
        now = staged(now.withColumn("sequence_id", F.col("sequence_id") + F.lit(first << 24)))
        first += blocks
        if blocks == 1:
            return functools.reduce(DataFrame.unionByName, [*done, now.select(*columns)])
        done.append(now.where(~F.col("passed")).select(*columns))
        blocks = -(-blocks // FAN_IN)
        met = now.where("passed").withColumn("block", F.pmod("block", F.lit(blocks)))
        now = met.drop("passed", "offset").groupBy("block").applyInPandas(_pack_block(capacity, PASSED_ON, True), schema)


def pack_documents(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(df, tokenizer, capacity, end_id), capacity)
