"""Evaluation passages inside training texts."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofind.llm.fmindex import FMIndex

#: Consecutive words that make a leak.
WORDS = 15
#: Words of one index; bounds a task's memory. Longer texts are indexed in overlapping pieces.
SHARD_WORDS = 300_000
#: Words of test material that are sent to a task at once; more are searched in several passes.
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
SPANS = "doc_id bigint, item_id bigint, first_word bigint, last_word bigint"


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case; none for null."""
    return _WORD.findall(text.casefold()) if text else []


def phrases(items: list[tuple[int, str | None]], length: int) -> tuple[list[str], np.ndarray, list[list[int]]]:
    """(vocabulary, word numbers of every distinct phrase of `length` words, the items of each phrase)."""
    number: dict[str, int] = {}
    owners: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for item, passage in items:
        coded = [number.setdefault(w, len(number)) for w in words(passage)]
        for i in range(len(coded) - length + 1):
            own = owners[tuple(coded[i : i + length])]
            if not own or own[-1] != item:
                own.append(item)
    return list(number), np.array(list(owners), np.int64).reshape(-1, length), list(owners.values())


def _merged(places: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    places = np.unique(places)
    breaks = np.flatnonzero(np.diff(places) > length) + 1
    for run in np.split(places, breaks):
        yield int(run[0]), int(run[-1]) + length - 1


class _Shard:
    """Texts of a task until there are enough words for an index."""

    def __init__(self, vocabulary: list[str], patterns: np.ndarray, owners: list[list[int]], length: int, most: int):
        self.vocabulary, self.patterns, self.owners, self.length, self.most = pa.array(vocabulary, pa.string()), patterns, owners, length, most
        self.docs: list[tuple[object, int, list[str]]] = []
        self.size = 0

    def add(self, doc_id: object, found: list[str]) -> Iterator[tuple]:
        step = self.most - self.length + 1
        for start in range(0, max(1, len(found) - self.length + 1), step):
            piece = found[start : start + self.most]
            if len(piece) < self.length:
                continue
            self.docs.append((doc_id, start, piece))
            self.size += len(piece)
            if self.size >= self.most:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """(doc_id, item_id, first_word, last_word) of the texts held so far."""
        docs, self.docs, self.size = self.docs, [], 0
        if not docs or not len(self.patterns):
            return
        coded = pa.array([w for _, _, piece in docs for w in piece], pa.string()).dictionary_encode()
        symbols = coded.indices.to_numpy().astype(np.int64) + 1
        index = FMIndex(np.split(symbols, np.cumsum([len(p) for _, _, p in docs])[:-1]), len(coded.dictionary))
        known = pc.fill_null(pc.index_in(self.vocabulary, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        asked = known[self.patterns]
        possible = np.flatnonzero((asked > 0).all(axis=1))
        begin, end = index.search(asked[possible])
        sizes = end - begin
        if not sizes.sum():
            return
        rows = np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        pattern = np.repeat(possible, sizes)
        document, place = index.locate(rows)
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, d, at in zip(pattern.tolist(), document.tolist(), place.tolist(), strict=True):
            for item in self.owners[p]:
                found[d, item].append(at)
        for (d, item), places in found.items():
            for first, last in _merged(np.array(places), self.length):
                yield docs[d][0], item, docs[d][1] + first, docs[d][1] + last


def _item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items, as many at a time as hold about block_words words; at least one block."""
    split = F.size(F.split("passage", r"\s+"))
    total = items.agg(F.sum(F.greatest(split, F.lit(1))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks).cast("bigint")) == block)
        yield sorted((r[0], r[1]) for r in mine.select("item_id", "passage").collect() if r[0] is not None and r[1] is not None)


def leaks(documents: DataFrame, items: DataFrame, length: int = WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, last_word: each span of a document (by word numbers from 0) in which
    at least `length` consecutive words of an item's passage stand; overlapping and touching spans of one
    item are merged, so removing them leaves no phrase of it behind.

    documents: doc_id, text; items: item_id, passage. Items are sent to the tasks in blocks of about
    block_words words, each of which is searched for in a pass over the corpus. The corpus isn't shuffled:
    each task indexes its own texts by shards of shard_words words and searches all phrases in them; only
    the spans move. Null texts, ids and passages and passages of fewer words match nothing. A text longer
    than a shard is indexed in pieces that overlap by length - 1 words, whose spans are merged at the end, so
    neither number changes the result.
    """
    found = None
    for block in _item_blocks(items, block_words):
        spans = _spans(documents, block, length, max(shard_words, 2 * length))
        found = spans if found is None else found.union(spans)
    pair = F.struct(F.col("first_word").alias("a"), F.col("last_word").alias("b"))
    ordered = found.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_list(pair)).alias("s"))
    # The last span takes in the next one where they overlap or touch.
    merged = F.aggregate("s", F.slice("s", 1, 1), lambda done, x: F.when(
        x["a"] <= F.element_at(done, -1)["b"] + 1,
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], x["b"]).alias("b")))),
    ).otherwise(F.concat(done, F.array(x))))
    return ordered.select("doc_id", "item_id", F.explode(merged).alias("m")).select("doc_id", "item_id", F.col("m.a").alias("first_word"), F.col("m.b").alias("last_word"))


def _spans(documents: DataFrame, block: list[tuple[int, str | None]], length: int, most: int) -> DataFrame:
    vocabulary, patterns, owners = phrases(block, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(vocabulary, patterns, owners, length, most)
        names = ["doc_id", "item_id", "first_word", "last_word"]

        def out(spans: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(4)], names=names)

        for batch in batches:
            spans: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans += shard.add(doc_id, words(text))
            yield out(spans)
        yield out(list(shard.flush()))

    return documents.select("doc_id", "text").mapInArrow(run, SPANS)
