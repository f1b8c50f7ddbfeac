"""Token counts from pre-token frequencies.

Texts are cut into pre-tokens. A block of documents becomes a table of per-document frequencies over the block's distinct
pre-tokens, and the distinct pre-tokens alone, dealt into buckets by a hash, are exchanged: a bucket's task puts each of
them through the tokenizer's model once and answers every block that asked. The answers join the block's frequencies,
and each document's count is the sum of frequency times pieces. No list of ids is ever made for a document. A very common
word is one entry per block like any other, so buckets are even; a task holds the vocabulary of one bucket.

Defined results: a null text counts as empty (0 bytes, 0 tokens); every input row gives one output row, repeated rows
included; a null doc_id is carried through; other columns are ignored; an empty table gives an empty result. Special
strings inside a text count as one token each, as the library treats them by default.
"""

from __future__ import annotations

import functools
import json
import pickle
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged, text_of, tokenizer_path

#: A block ends after so many documents or pre-tokens; it is what one group of the last step holds.
BLOCK_DOCS, BLOCK_PRETOKENS = 60_000, 5_000_000
#: Buckets of pre-tokens, the most tasks that count side by side.
BUCKETS = 4096

#: bucket -1 holds the block's documents and frequencies, the others their share of its distinct pre-tokens.
_ROWS = "block long, bucket int, data binary"
_COUNTS = "doc_id long, n_bytes long, n_tokens long"


class PreTokens:
    """The pre-tokens of a text as a tokenizer file defines them (a normalizer and a Split pattern, then byte level)."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self._split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        special = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self._marks = special
        plain = [c for c in map(chr, range(0x250)) if c in "\t\n\r" or 0x20 <= ord(c) < 0x7F or ord(c) > 0xA0 and c != "İ"]
        lowered = sorted({x for c in plain for x in c.lower()})
        kind = lambda k: "".join(re.escape(c) for c in lowered if unicodedata.category(c)[0] == k)
        self._unusual = re.compile("[^" + "".join(map(re.escape, plain)) + "]")
        self._find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kind('L')}]+|[{kind('N')}]|[^\\s{kind('L')}{kind('N')}]+").findall

    def words(self, text: str) -> list[str]:
        """Latin texts go by Python's re, which agrees there (tested over all these characters); others by the library."""
        if not self._unusual.search(text):
            return self._find(text.lower())
        text = self.tokenizer.normalizer.normalize_str(text)
        return [w for w, _ in self._split.pre_tokenize_str(text)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens and the number of special strings."""
        if not any(mark in text for mark in self._marks):
            return self.words(text), 0
        pieces = self._special.split(text)
        return [w for p in pieces for w in self.words(p)], len(pieces) - 1

    def sizes(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def _pretokens(path: str) -> PreTokens:
    return PreTokens(path)


class _Block:
    """Documents on their way into a frequency table."""

    def __init__(self):
        self.ids: list = []
        self.bytes: list[int] = []
        self.specials: list[int] = []
        self.codes: list[np.ndarray] = []
        self.size = 0
        self.code = defaultdict(count().__next__)

    def add(self, doc_id, text: str, n_bytes: int, cut: PreTokens) -> None:
        words, special = cut.parts(text)
        self.ids.append(doc_id)
        self.bytes.append(n_bytes)
        self.specials.append(special)
        self.codes.append(np.fromiter(map(self.code.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rows(self, block: int) -> Iterator[tuple[int, int, bytes]]:
        """The frequency table with words numbered bucket by bucket, then each bucket's words."""
        words, n = list(self.code), len(self.ids)
        self.code.clear()
        bucket = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        doc = np.repeat(np.arange(n), [len(c) for c in self.codes])
        code = place[np.concatenate(self.codes)] if words else np.zeros(0, np.int64)
        self.codes.clear()
        pairs, freqs = np.unique(code * n + doc, return_counts=True)
        word, doc = np.divmod(pairs, n)
        each = np.bincount(word, minlength=len(words)).astype(np.uint16 if n < 65_536 else np.uint32)
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        arrays = (ids, known, np.array(self.bytes, np.int64), np.array(self.specials, np.int64), each, doc.astype(np.uint16), freqs.astype(np.uint16 if not len(freqs) or freqs.max() < 65_536 else np.uint32))
        yield block, -1, zlib.compress(pickle.dumps(arrays, protocol=5), 1)
        ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).tolist()
        names = [words[i] for i in order.tolist()]
        for b in range(BUCKETS):
            if ends[b] < ends[b + 1]:
                yield block, b, "\n".join(names[ends[b] : ends[b + 1]]).encode()


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "bucket", "data"])


def _to_rows(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, block, n = _pretokens(tokenizer_path(tokenizer)), _Block(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if block.ids and (block.size + len(text) // 4 > BLOCK_PRETOKENS or len(block.ids) >= BLOCK_DOCS):
                    yield _batch(list(block.rows((part << 24) + n)))
                    block, n = _Block(), n + 1
                block.add(doc_id, text, len(text.encode()), cut)
        if block.ids:
            yield _batch(list(block.rows((part << 24) + n)))

    return run


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by bucket: what a bucket's earlier rows asked for is known until the next bucket."""
        cut, now, known = _pretokens(tokenizer_path(tokenizer)), None, {}
        for batch in batches:
            out = []
            for block, bucket, data in zip(*(batch[c].to_pylist() for c in ("block", "bucket", "data")), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                words = data.decode().split("\n")
                new = [w for w in words if w not in known]
                known.update(zip(new, cut.sizes(new), strict=True))
                out.append((block, bucket, np.fromiter(map(known.__getitem__, words), np.uint32, len(words)).tobytes()))
            yield _batch(out)

    return run


def _sum(frequencies: pa.Table, answers: pa.Table) -> pa.Table:
    """One block's documents."""
    ids, known, n_bytes, total, each, doc, freqs = pickle.loads(zlib.decompress(frequencies["data"][0].as_py()))
    in_order = answers.sort_by("bucket")["data"].to_pylist()
    pieces = np.repeat(np.frombuffer(b"".join(in_order), np.uint32), each).astype(np.float64)
    total = total + np.bincount(doc, weights=pieces * freqs, minlength=len(ids)).astype(np.int64)
    return pa.table({"doc_id": pa.array(ids, mask=~known), "n_bytes": n_bytes, "n_tokens": total})


def token_counts(df: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    texts = df.select(F.col("doc_id").cast("long"), text_of(df).alias("text"))
    rows = staged(texts.mapInArrow(_to_rows(tokenizer), _ROWS))
    asked = rows.where(F.col("bucket") >= 0).repartition("bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(_count(tokenizer), _ROWS).groupBy("block")
    per_doc = rows.where(F.col("bucket") < 0).groupBy("block").cogroup(answers).applyInArrow(_sum, _COUNTS)
    return per_doc.withColumn("over_limit", F.col("n_tokens") > limit)
