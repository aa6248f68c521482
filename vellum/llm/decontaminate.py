"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Every word n-gram of a benchmark item is a seed. One pass over the documents finds the places
where seeds may occur: a bitmap of fixed size over the seeds' hashes passes all of them and few
other places, and an exact join on the hash follows. Around the places a document gives up
passages, as many words to either side as the longest item has; overlapping passages are one.
Every passage is aligned by words with every item that it shares a seed with, however common the
seed; passages of equal words are aligned once. The score is the local alignment's share of
the best possible one; a document is contaminated by an item at a score of `threshold` or more.

Cases: null and empty texts and items have no seeds; items of fewer words than a seed have one
seed, their whole word sequence; texts of any length are read whole, in passages; equal scores
give the first passage; rows that repeat a doc_id (or have none) with equal text give one row,
with different texts rows of their own; an item_id, or null, with several texts stands for the
best of them; repeated items count once; an
empty table on either side gives no contamination; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.neardup import combine
from vellum.llm.secrets import slices
from vellum.plans.runtime import Scratch

SEED, THRESHOLD = 4, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the seeds' bitmap: 8 MB whatever the benchmark's size.
BITS = 26

WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case."""
    return WORDS.findall((text or "").lower())


def seeds(words: list[str], n: int = SEED) -> np.ndarray:
    """The hashes of a text's n-grams by place; of fewer words, the one of the whole sequence."""
    if not words:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = min(n, len(h))
    return combine(h, n, len(h) - n + 1).view(np.int64)


def item_seeds(benchmark: DataFrame, n: int = SEED) -> DataFrame:
    """(item_id, item_key, words, n_words, seeds) of the items that have words; item_key tells texts of one id, or of none, apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            keys = [hashlib.blake2b(f"{i} {' '.join(w)}".encode(), digest_size=16).digest() for i, w in zip(batch.column(0).to_pylist(), words, strict=True)]
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(words, pa.list_(pa.string())), pa.array([len(w) for w in words], pa.int32()), pa.array([seeds(w, n).tolist() for w in words], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item_key", "words", "n_words", "seeds"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return items.mapInArrow(run, "item_id long, item_key binary, words array<string>, n_words int, seeds array<long>").where("n_words > 0")


def _bitmap(items: DataFrame) -> np.ndarray:
    """One bit for the low bits of each seed; the driver gets at most 2**BITS of them, 16 bytes for each byte set."""
    slots = items.select(F.explode("seeds").alias("s")).select(F.col("s").bitwiseAND((1 << BITS) - 1).alias("slot"))
    rows = slots.select(F.shiftright("slot", 3).alias("byte"), F.expr("shiftleft(1, cast(slot & 7 AS int))").alias("bit"))
    table = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[np.asarray(table["byte"]).astype(np.int64)] = np.asarray(table["bits"]).astype(np.uint8)
    return out


def spaced_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words as words_of gives them, one after another, and how many each text has."""
    texts = pc.utf8_lower(pc.coalesce(texts.cast(pa.large_string()), pa.scalar("", pa.large_string())))
    lists = pc.split_pattern(pc.replace_substring_regex(texts, r"[^\pL\pN]+", " "), " ")
    flat, parents = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    filled = pc.not_equal(flat, "")
    return flat.filter(filled), np.bincount(parents[np.asarray(filled)], minlength=len(texts))


PASSAGES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("passage_id", T.BinaryType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("seeds", T.ArrayType(T.LongType())),
    ]
)


def passages(docs: DataFrame, bitmap: np.ndarray, reach: int, lengths: list[int]) -> DataFrame:
    """The documents' passages around possible seeds; passage_id, of 128 bits, stands for the words.

    lengths: the seeds' numbers of words, several if some items have fewer words than a seed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.int64((1 << BITS) - 1)
        for batch in slices(batches, "text"):
            flat, counts = spaced_words(batch.column(1))
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
            h = table[np.asarray(coded.indices)]
            ends = np.cumsum(counts)
            doc_of = np.repeat(np.arange(len(counts)), counts)
            where, found = [], []
            for m in lengths:
                if len(h) < m:
                    continue
                grams = combine(h, m, len(h) - m + 1).view(np.int64)
                slot = grams & mask
                at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                at = at[at + m <= ends[doc_of[at]]]
                where.append(at)
                found.append(grams[at])
            if not where:
                continue
            where, found = np.concatenate(where), np.concatenate(found)
            order = np.argsort(where, kind="stable")
            where, found = where[order], found[order]
            if not len(where):
                continue
            # A passage ends where the next place is too far off or in another document.
            new = np.flatnonzero((np.diff(where) > 2 * reach) | (np.diff(doc_of[where]) > 0)) + 1
            rows: dict[str, list] = {f.name: [] for f in PASSAGES}
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part in np.split(np.arange(len(where)), new):
                d = int(doc_of[where[part[0]]])
                begin = int(ends[d] - counts[d])
                low, high = max(begin, int(where[part[0]]) - reach), min(int(ends[d]), int(where[part[-1]]) + reach)
                words = flat.slice(low, high - low).to_pylist()
                rows["doc_id"].append(ids[d])
                rows["text_hash"].append(hashes[d])
                rows["passage_id"].append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
                rows["first_word"].append(low - begin)
                rows["words"].append(words)
                rows["seeds"].append(sorted(set(found[part].tolist())))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("passage_id", pa.binary()), ("first_word", pa.int64()), ("words", pa.list_(pa.string())), ("seeds", pa.list_(pa.int64()))]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(F.col("text"))).mapInArrow(run, PASSAGES)


def text_hash(text: Column) -> Column:
    """Tells documents of one doc_id, or of none, apart by their texts."""
    return F.xxhash64(text.cast("string")).alias("text_hash")


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over word codes with linear gaps: (best score, passage place after its end).

    Row by row over the item; a row's gaps along the passage come from one running maximum.
    """
    n = len(passage)
    ramp = np.arange(1, n + 1) * -GAP
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        step = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        step = np.maximum(np.maximum(step, row[1:] + GAP), 0)
        step = np.maximum.accumulate(step + ramp) - ramp
        row = np.concatenate([[0], step])
        if (top := int(step.max())) > best:
            best, end = top, int(step.argmax()) + 1
    return best, end


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, n: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, score, n_passages): each document and item that meet, with the best alignment's score.

    Rows below the threshold stay in, for inspection; `contaminated` tells them apart.
    """
    items = scratch.save(item_seeds(benchmark, n), "items")
    reach = (items.agg(F.max("n_words")).first()[0] or 0) + n
    lengths = sorted(r[0] for r in items.select(F.least("n_words", F.lit(n)).alias("m")).distinct().collect())
    found = scratch.save(passages(docs, _bitmap(items), reach, lengths), "passages")
    texts = scratch.save(found.select("passage_id", "words", "seeds").dropDuplicates(["passage_id"]), "texts")
    by_seed = items.select("item_key", F.explode("seeds").alias("seed")).distinct()
    pairs = texts.select("passage_id", F.explode("seeds").alias("seed")).join(by_seed, "seed").select("passage_id", "item_key").distinct()
    joined = pairs.join(texts.select("passage_id", "words"), "passage_id").join(items.select("item_key", "item_id", F.col("words").alias("item")).dropDuplicates(["item_key"]), "item_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for passage, item in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
                best, _ = align(np.array([codes.get(w, -1) for w in passage]), np.array([codes[w] for w in item]))
                scores.append(best / (MATCH * len(item)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["passage_id", "item_id", "score"])

    scored = joined.select("passage_id", "item_id", "words", "item").mapInArrow(run, "passage_id binary, item_id long, score double")
    places = found.select("doc_id", "text_hash", "passage_id", "first_word").distinct()
    best = places.join(scored, "passage_id").groupBy("doc_id", "text_hash", "item_id").agg(F.max("score").alias("score"), F.count("*").alias("n_passages"))
    return scratch.finish(best.withColumn("contaminated", F.col("score") >= threshold))
