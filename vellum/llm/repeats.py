"""Removal of repeated byte strings: column-wise construction over a collection of windows.

A string of `length` bytes that starts at two places is found where it is compared: every such
window has one minimizer (the least hash of its K-byte grams, leftmost of equals), so equal
windows have theirs at the same offset. The windows that share a minimizer place form a
segment of the text, cut into a right half (windows that reach at least SPLIT bytes past the
minimizer's start) and a left half, and each half is keyed by the hash of the bytes that all
its windows hold, some 200 bytes, so that a frequent short line keys nothing. Only segments
whose key occurs twice are taken out of the texts.

All segments of a key are aligned at their minimizer. Column by column from the right, each
round inserts one symbol of every segment of the collection: it stably sorts the segments by
the new symbol, which keeps the collection's Burrows-Wheeler order (the symbols in the order
of the suffixes right of them), and updates the common prefixes of neighbours by range minima
over the prefixes of the column before. Since equal windows are in the same column, a column's
order needs no suffixes of other columns, so a round costs as much as the collection has
segments, not as its whole transform has symbols. The columns are read and written in sequence
over a bounded batch of segments; they stay in memory, where a file in a machine's own folder
would be of no use to another machine. A window repeats where its common prefix with a
neighbour is `length` or more.

Equal segments are counted before the construction (pre-aggregated ahead of their shuffle), so
that a group of copies, however large, puts one segment into it.

Cases: null text counts as empty; texts shorter than `length` hold no window; matches never
cross documents; overlapping windows all count, within one document too; equal documents of at
least `length` bytes are removed whole; rows that repeat a doc_id are documents of their own;
equal hashes of different bytes cannot matter within a construction, as it compares symbols; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.neardup import lists
from vellum.llm.secrets import slices
from vellum.plans.runtime import Scratch

LENGTH, K = 400, 32
#: Windows whose minimizers are searched at a time, and segments in one construction.
CHUNK, BATCH = 1 << 20, 8192
#: An odd multiplier of rolling hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Each byte value's own 64-bit constant.
MIXED = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


class Rolling:
    """Hashes of any substring of up to CHUNK + LENGTH bytes: the sum of MIXED[byte] * BASE**i, moved to i = 0."""

    up = down = None

    def __init__(self, data: np.ndarray):
        if Rolling.up is None:
            Rolling.up, Rolling.down = _powers(BASE, CHUNK + 2 * LENGTH), _powers(INVERSE, CHUNK + 2 * LENGTH)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(MIXED[data] * Rolling.up[: len(data)], out=self.prefix[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return self._mixed((self.prefix[size:] - self.prefix[:n]) * Rolling.down[:n])

    def some(self, at: np.ndarray, size: int) -> np.ndarray:
        return self._mixed((self.prefix[at + size] - self.prefix[at]) * Rolling.down[at])

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def runs(data: np.ndarray, rolling: Rolling, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer's place, first window, last window) of each run of windows with one minimizer.

    The low 24 bits of a gram's hash give way to its place, so that the least of a window is
    the leftmost of equal ones. Sliding minima by blocks: a block's running minimum towards its
    start meets the next block's running minimum towards its end.
    """
    w, windows = length - k + 1, len(data) - length + 1
    grams = rolling.all(k)
    grams &= np.uint64(0xFFFFFFFFFF000000)
    grams |= np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(grams) // w)
    grid = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(grams)] = grams
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return place[first], first, np.concatenate([first[1:] - 1, [windows - 1]])


def halves(text: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, minimizer's place, first window, last window) of a text's half segments, in bytes.

    The windows of a right half all hold the bytes from the minimizer to `reach` behind it,
    those of a left half all hold the bytes from `split` before the minimizer to its end.
    """
    split = (length - k + 1) // 2 + 1
    reach = length - (split - 1)
    whole = np.frombuffer(text, np.uint8)
    out = []
    for base in range(0, max(0, len(text) - length + 1), CHUNK):
        data = whole[base : base + CHUNK + length - 1]
        rolling = Rolling(data)
        place, first, last = runs(data, rolling, length, k)
        right = last > place - split
        left = first <= place - split
        p = place[right]
        out.append((rolling.some(p, reach) & ~np.uint64(1), base + p, base + np.maximum(first[right], p - split + 1), base + last[right]))
        p = place[left]
        out.append((rolling.some(p - split, split + k) | np.uint64(1), base + p, base + first[left], base + np.minimum(last[left], p - split)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    key, place, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    return key.view(np.int64), place, first, last


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def characters(text: bytes) -> int:
    """Code points whose first byte is there."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def twice(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, those that occur more than once two times."""
    values, counts = np.unique(keys, return_counts=True)
    return np.repeat(values, np.minimum(counts, 2))


def keyed(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, tk, n_bytes, n_chars, keys): tk is the text's SHA-256, keys those of its half segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = _bytes(batch.column(1))
            columns = [batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([characters(t) for t in texts], pa.int64()), lists([twice(halves(t, length, k)[0]) for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "n_bytes", "n_chars", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, tk binary, n_bytes long, n_chars long, keys array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


SEGMENTS = T.StructType([T.StructField(n, t) for n, t in (("key", T.LongType()), ("sh", T.BinaryType()), ("tk", T.BinaryType()), ("start", T.LongType()), ("off", T.IntegerType()), ("seg", T.BinaryType()))])


def segments(candidates: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """The half segments of (tk, keys, text) that have one of the keys: start, offset to the minimizer, bytes."""
    names = SEGMENTS.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", limit=2 << 20):
            rows: dict[str, list] = {n: [] for n in names}
            texts = _bytes(batch.column(2))
            for tk, keys, text in zip(batch.column(0).to_pylist(), batch.column(1), texts, strict=True):
                key, place, first, last = halves(text, length, k)
                for i in np.flatnonzero(np.isin(key, np.asarray(keys.values))).tolist():
                    a, off = int(first[i]), int(place[i] - first[i])
                    seg = text[a : int(last[i]) + length]
                    rows["key"].append(int(key[i]))
                    rows["sh"].append(hashlib.blake2b(seg, digest_size=16, salt=off.to_bytes(4, "little")).digest())
                    rows["tk"].append(tk)
                    rows["start"].append(a)
                    rows["off"].append(off)
                    rows["seg"].append(seg)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("key", pa.int64()), ("sh", pa.binary()), ("tk", pa.binary()), ("start", pa.int64()), ("off", pa.int32()), ("seg", pa.binary())]))

    return candidates.select("tk", "keys", "text").mapInArrow(run, SEGMENTS)


def columns(segs: list[bytes], offs: np.ndarray) -> np.ndarray:
    """[column, segment] symbols (byte + 1, 0 where the segment has none), minimizers in one column."""
    left, right = int(offs.max()), max(len(s) - int(o) for s, o in zip(segs, offs, strict=True))
    out = np.zeros((len(segs), left + right), np.uint16)
    for i, (s, o) in enumerate(zip(segs, offs.tolist(), strict=True)):
        out[i, left - o : left - o + len(s)] = np.frombuffer(s, np.uint8)
        out[i, left - o : left - o + len(s)] += 1
    return np.ascontiguousarray(out.T)


def construct(symbols: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """[window's column, segment]: whether the window repeats in another segment of its group.

    group: group numbers, ascending. order and common hold, after the round of a column, the
    segments in the order of their suffixes from that column on and each one's common prefix
    with the one before it; groups keep their own ranges of places throughout.
    """
    n_columns, n = symbols.shape
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    base = group.astype(np.int64) * 257
    hits = np.zeros((n_columns, n), bool)
    for column in range(n_columns - 1, -1, -1):
        symbol = symbols[column][order]
        sort_key = base + symbol
        if (np.diff(sort_key) < 0).any():
            move = np.argsort(sort_key, kind="stable")
            order, symbol, sort_key = order[move], symbol[move], sort_key[move]
            prefix = common[move]
            apart = np.flatnonzero(np.diff(move) != 1) + 1
            apart = apart[(sort_key[apart] == sort_key[apart - 1]) & (symbol[apart] > 0)]
            if len(apart):
                # Least common prefix over the places between the two in the order before.
                bounds = np.stack([move[apart - 1] + 1, move[apart] + 1], axis=1).ravel()
                prefix[apart] = np.minimum.reduceat(common, bounds)[::2]
        else:
            prefix = common[:n]
        same = np.zeros(n, bool)
        same[1:] = (sort_key[1:] == sort_key[:-1]) & (symbol[1:] > 0)
        common = np.zeros(n + 1, np.int32)
        common[:n][same] = prefix[same] + 1
        long = common >= length
        if long.any():
            hits[column, order[long[:-1] | long[1:]]] = True
    return hits


REPEATED = T.StructType([T.StructField("key", T.LongType()), T.StructField("sh", T.BinaryType()), T.StructField("first", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.LongType()))])


def repeated(distinct: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, sh, first, last): ranges of windows, counted from the segment's start, that repeat.

    distinct: (key, sh, copies, off, seg), dealt and sorted by key.
    """

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in REPEATED}

        def put(row, first, last):
            out["key"].append(row[0])
            out["sh"].append(row[1])
            out["first"].append(first)
            out["last"].append(last)

        keys, group, sizes = np.unique([r[0] for r in rows], return_inverse=True, return_counts=True)
        shared = sizes[group] > 1
        for row in rows:
            if row[2] > 1:
                put(row, [0], [len(row[4]) - length])
        live = [i for i in np.flatnonzero(shared).tolist()]
        live.sort(key=lambda i: group[i])
        for lo, hi in _batches(group[live]):
            part = [rows[i] for i in live[lo:hi]]
            offs = np.array([r[3] for r in part])
            hits = construct(columns([r[4] for r in part], offs), group[live[lo:hi]], length)
            left = int(offs.max())
            edges = np.diff(np.pad(hits.astype(np.int8), ((1, 1), (0, 0))), axis=0)
            for j in np.flatnonzero(hits.any(axis=0)).tolist():
                if part[j][2] > 1:
                    continue
                shift = left - int(offs[j])
                first, last = np.flatnonzero(edges[:, j] == 1) - shift, np.flatnonzero(edges[:, j] == -1) - 1 - shift
                put(part[j], first.tolist(), last.tolist())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("sh", pa.binary()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)
            if len(held) > BATCH:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield from flush(held[:cut])
                    held = held[cut:]
        if held:
            yield from flush(held)

    return distinct.select("key", "sh", "copies", "off", "seg").mapInArrow(run, REPEATED)


def _batches(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BATCH places that part no group."""
    lo = 0
    while lo < len(group):
        hi = min(len(group), lo + BATCH)
        while hi < len(group) and group[hi] == group[hi - 1]:
            hi += 1
        yield lo, hi
        lo = hi


def cut(text: bytes, first: list[int], last: list[int], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left) for ranges of windows."""
    removed = spans = at = 0
    kept = []
    stop = -1
    for a, b in sorted(zip(first, last, strict=True)):
        b += length
        if a > stop:
            spans += 1
            kept.append(text[at:a])
            stop = a
        if b > stop:
            removed += b - stop
            stop = b
        at = stop
    kept.append(text[at:])
    return removed, spans, b"".join(kept)


def _removed(found: DataFrame, length: int, whole: bool) -> DataFrame:
    """(tk, n_removed, n_spans, kept_sha256, kept_chars) and with whole=True the text that is left, from (tk, text, first, last)."""
    schema = "tk binary, n_removed long, n_spans long, kept_sha256 string, kept_chars long" + (", kept_text string" if whole else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tks, firsts, lasts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            rows = []
            for tk, text, first, last in zip(tks, _bytes(batch.column(1)), firsts, lasts, strict=True):
                removed, spans, kept = cut(text, first, last, length)
                rows.append((tk, removed, spans, hashlib.sha256(kept).hexdigest(), characters(kept), kept.decode("utf-8", "ignore") if whole else None))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())[: 6 if whole else 5])]
            yield pa.RecordBatch.from_arrays(columns, names=["tk", "n_removed", "n_spans", "kept_sha256", "kept_chars", "kept_text"][: len(columns)])

    return found.select("tk", "text", "first", "last").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_chars, repeats), one row per document.

    kept_chars: the code points left, counted by their first bytes; repeats: whether any byte went.
    """
    rows = scratch.save(keyed(docs, length, k), "keys")
    # One row a text: copies need no more keys than the first of them.
    texts = scratch.save(rows.groupBy("tk").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("text_copies"), F.first("keys").alias("keys")), "texts")
    keys = texts.select("tk", "doc_id", F.explode("keys").alias("key"))
    # A key that one text has twice is listed twice: a window may repeat within its text.
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = keys.join(often, "key").groupBy("tk").agg(F.first("doc_id").alias("doc_id"), F.collect_set("key").alias("keys"))
    text = _texts(docs).where("text IS NOT NULL").withColumn("sha", F.unhex(F.sha2("text", 256)))
    same = (F.col("wanted.doc_id").eqNullSafe(F.col("t.doc_id"))) & (F.col("tk") == F.col("sha"))
    candidates = scratch.save(text.alias("t").join(wanted.alias("wanted"), same).select("tk", "keys", "text"), "candidates")
    found = scratch.save(segments(candidates, length, k), "segments")
    distinct = found.groupBy("key", "sh").agg(F.count("*").alias("copies"), F.first("off").alias("off"), F.first("seg").alias("seg"))
    ranges = scratch.save(repeated(distinct.repartition("key").sortWithinPartitions("key"), length), "ranges")
    placed = found.select("key", "sh", "tk", "start").join(ranges, ["key", "sh"])
    placed = placed.select("tk", F.explode(F.arrays_zip("first", "last")).alias("r"), "start").select("tk", (F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.last")).alias("last"))
    per = placed.distinct().groupBy("tk").agg(F.collect_list(F.struct("first", "last")).alias("r")).select("tk", F.col("r.first").alias("first"), F.col("r.last").alias("last"))
    hit = candidates.select("tk", "text").join(per, "tk")
    done = scratch.save(_removed(hit, length, False).dropDuplicates(["tk"]), "removed")
    out = rows.select("doc_id", "tk", "n_bytes", "n_chars").join(texts.select("tk", "text_copies"), "tk").join(done, "tk", "left")
    copied = (F.col("text_copies") > 1) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    result = out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("tk")))).alias("kept_sha256"),
        F.when(copied, F.lit(0)).otherwise(F.coalesce("kept_chars", "n_chars")).cast("long").alias("kept_chars"),
        (copied | (F.coalesce("n_removed", F.lit(0)) > 0)).alias("repeats"),
    )
    return scratch.finish(result)
