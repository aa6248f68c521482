"""Near-duplicate components by bottom-k sketches from one hash function.

A document's set is its distinct word shingles, hashed once to 64 bits; its sketch is the k
smallest hashes. Documents with the same set are one node. Inverted lists of retained values
give the candidates: of two sets with the wanted similarity at least `least_shared` retained
values are the same (but for a chance of under 1e-10), so it is enough to list each node under
its rarest values, all but least_shared - 1 of them (prefix filtering, with the values ordered
by how many sketches retain them). A value that very many documents retain thereby lists only
documents that are made of such values.

Lists are searched in steps, without listing the pairs of a group:
1. Each node is compared with one representative of its lists, the one it shares most lists
   with. Links found here join copies of one text, however many there are, in linear time.
2. Nodes of very long lists that still hold several components are listed anew under the
   rarest shingles of their full sets (the same prefix filter, exact there) and compared with
   a representative again.
3. Lists of over SHORT nodes that still hold several components are gathered into clusters,
   lists with a node in common into one. Where that takes no more comparisons than the lists by
   themselves, a cluster's nodes are compared by their full sets, each node sent once for each
   other block of its cluster, and only links that join components come out of it.
4. Within the other lists nodes of different components are compared by the sketch of their
   union. Nodes already connected need no comparison: it could not change the components.
Every link is confirmed on the full sets of shingle hashes.

Cases: documents that are null, empty or without words have an empty set and stand alone; with
fewer words than a shingle the whole sequence is the one shingle; texts of any length are read
whole; rows that repeat a doc_id with equal text fall together, with different texts they stay
apart but may share a smallest doc_id; null doc_ids are kept, a component of nothing but these
has component_id null, and kept is false there; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vellum.llm.components import connected_components
from vellum.llm.secrets import slices
from vellum.plans.runtime import Scratch

#: Retained values a sketch, and the chance of losing a link that `least_shared` allows.
SKETCH, LOSS = 64, 1e-10
#: Lists of up to SHORT nodes are compared by sketches, of up to LONG by wide ones; the nodes of
#: longer ones are listed anew by their full sets first.
SHORT, LONG = 32, 8192
#: Values of a full set that pairs are compared by ahead of their confirmation.
WIDE = 128
#: A node's rarest lists, whose heads it may be compared with first.
VOTES = 8
#: Members of a list that one task compares with one another, or with as many others. Smaller
#: blocks send each row to more tasks; this one keeps lists of up to LONG whole.
BLOCK = 8192
#: Hashes of full sets in a block of a cluster.
CLUSTER_BLOCK = 4 << 20
#: Columns of an incidence matrix in the comparison of a block of nodes; it bounds its memory.
VALUES = 4096


def least_shared(similarity: float, k: int = SKETCH, loss: float = LOSS) -> int:
    """The largest o such that fewer than o of k values of the union's sketch are shared with probability at most `loss`."""
    tail, o = 0.0, 0
    while True:
        tail += math.comb(k, o) * similarity**o * (1 - similarity) ** (k - o)
        if tail > loss:
            return max(1, o)
        o += 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words (A-Z lower-cased) one after another, and the number a text has."""
    # Lowered before the cast: a cast slice keeps its offsets, which ascii_lower misreads.
    texts = pc.coalesce(pc.ascii_lower(texts).cast(pa.large_string()), pa.scalar("", pa.large_string()))
    lists = pc.ascii_split_whitespace(texts)
    flat, parents = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    filled = pc.not_equal(flat, "")
    coded = flat.filter(filled).dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    counts = np.bincount(parents[np.asarray(filled)], minlength=len(texts))
    codes = np.asarray(coded.indices)
    return (table[codes] if len(codes) else np.zeros(0, np.uint64)), counts


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def combine(h: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes; entry i covers i to i + n - 1 (size: entries wanted)."""
    with np.errstate(over="ignore"):
        out = np.full(size, np.uint64(n * 0x1F3D5B79), np.uint64)
        for j in range(n):
            out = mix(out * np.uint64(0x100000001B3) + h[j : j + size])
    return out


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (signed) of each text."""
    words, counts = word_hashes(texts)
    grams = combine(words, n, max(0, len(words) - n + 1))
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1].view(np.int64)))
        elif c:
            out.append(combine(words[at : at + c], c, 1).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += c
    return out


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def sketches(docs: DataFrame, n: int, k: int = SKETCH) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fp, sketch); fp, of 128 bits, stands for the whole set and is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1), n)
            fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), lists([s[:k] for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "fp", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, fp binary, sketch array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(fp, hashes) of the wanted (doc_id, text_hash, fp): the text of one document a node is read again.

    Rows of one doc_id, or of none, are told apart by the hash of their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1), n)
            fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            same = [i for i, (a, b) in enumerate(zip(fps, batch.column(0).to_pylist(), strict=True)) if a == b]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same, pa.int64())), lists([sets[i] for i in same])], names=["fp", "hashes"])

    key = [F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash"]
    joined = _texts(docs).select(*key, "text").join(wanted.select(*key, "fp"), ["doc_id", "text_hash"]).select("fp", "text")
    return joined.mapInArrow(run, "fp binary, hashes array<long>").dropDuplicates(["fp"])


def enough(shared: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """den * intersection >= num * union."""
    return shared * den >= (a + b - shared) * num


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as edges (u, v)."""
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb")).cast("long")
    return both.where(enough(shared, F.size("ha").cast("long"), F.size("hb").cast("long"), num, den)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def listing(values: DataFrame) -> DataFrame:
    """Of (fp, value, size, m, ...): the rows under the first m places of each fp's values by rarity, with `place`.

    Values that nothing else holds are the rarest of all; they take up places but list nothing.
    """
    often = values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    per = W.partitionBy("fp")
    place = F.row_number().over(per.orderBy("often", "value")) + F.col("size") - F.count("*").over(per)
    return values.join(often, "value").withColumn("place", place).where(F.col("place") <= F.col("m"))


def stars(listed: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b): each node with the head of its lists it shares most lists with; heads are a list's least hash."""
    heads = listed.groupBy("value").agg(F.min(F.struct(F.xxhash64("fp", F.lit(seed)).alias("h"), "fp")).alias("head")).select("value", F.col("head.fp").alias("head"))
    votes = listed.join(heads, "value").where("fp != head").groupBy("fp", "head").agg(F.count("*").alias("votes"))
    return votes.groupBy("fp").agg(F.max(F.struct("votes", "head")).alias("best")).select(F.col("fp").alias("a"), F.col("best.head").alias("b"))


def open_lists(listed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed rows with their labels, and (value, members) of the lists that hold several labels."""
    named = listed.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lists = named.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members"))
    return named, lists.where("x != y").select("value", "members")


def compare(n: np.ndarray, labels: list, sketches: list[np.ndarray], k: int | None, num: int, den: int, here: Callable = lambda x, y: True, left: int | None = None, block: int = 512) -> Iterator[tuple[int, int]]:
    """Pairs of a list's members with different labels that may be similar enough, by blocks of members.

    left: how many members stand on the left; only pairs of a left and a right member are
    looked at. None: all pairs. Sets of at most k hashes are their own sketches (k None: all
    are); pairs of these are decided here, and only those that join components are returned. Of
    other pairs all are returned whose sketches share as many values as similar sets' sketches do.
    """
    wanted, root = 0 if k is None else least_shared(num / den, k), {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def parts(low: int, high: int) -> list[range]:
        return [range(i, min(i + block, high)) for i in range(low, high, block)]

    if left is None:
        pairs = [(p, q) for p in parts(0, len(n)) for q in parts(0, len(n)) if p.start <= q.start]
    else:
        pairs = [(p, q) for p in parts(0, left) for q in parts(left, len(n))]
    _, label = np.unique(np.array(labels, object).astype("S32"), return_inverse=True)
    for left_part, right_part in pairs:
        i, j = left_part.start, right_part.start
        values, codes = np.unique(np.concatenate([sketches[x] for x in (*left_part, *right_part)]), return_inverse=True)
        rows = np.repeat(np.arange(len(left_part) + len(right_part)), [len(sketches[x]) for x in (*left_part, *right_part)])
        often = np.bincount(codes, minlength=len(values)) > 1
        codes, rows = (np.cumsum(often) - 1)[codes][often[codes]], rows[often[codes]]
        shared = np.zeros((len(left_part), len(right_part)), np.float32)
        order = np.argsort(codes, kind="stable")
        codes, rows = codes[order], rows[order]
        # Counts of shared values as products of incidence matrices, so many values at a time.
        for low in range(0, int(often.sum()), VALUES):
            part = slice(*np.searchsorted(codes, (low, low + VALUES)))
            held = np.zeros((len(left_part) + len(right_part), VALUES), np.float32)
            held[rows[part], codes[part] - low] = 1
            shared += held[: len(left_part)] @ held[len(left_part) :].T
        shared = shared.astype(np.int64)
        na, nb = n[left_part, None], n[None, right_part]
        exact = np.maximum(na, nb) <= (np.inf if k is None else k)
        enough = np.where(exact, shared * (num + den) >= (na + nb) * num, shared >= np.minimum(-(-np.minimum(na, nb) * num // den), wanted))
        enough &= (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (label[left_part, None] != label[None, right_part])
        for x, y in zip(*np.nonzero(enough), strict=True):
            if i + x < j + y:
                p, q = find(int(label[i + x])), find(int(label[j + y]))
                if p != q and here(i + int(x), j + int(y)):
                    if exact[x, y]:
                        root[p] = q
                    yield i + int(x), j + int(y)


def clusters(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of listed rows (value, fp, n, members): (fp, cluster, blocks) of the clusters, and the values of lists that stay by themselves.

    A cluster holds the lists that nodes connect. It is compared as one if its nodes' pairs are
    no more than those of its lists together.
    """
    heads = rows.groupBy("value").agg(F.min("fp").alias("head"), F.first("members").alias("members"))
    edges = rows.join(heads.select("value", "head"), "value").select(F.col("fp").alias("u"), F.col("head").alias("v")).distinct()
    of_node = scratch.save(connected_components(edges, scratch), "clusters")
    of_list = heads.join(of_node, F.col("head") == F.col("node")).select("value", F.col("label").alias("cluster"), F.col("members").cast("double").alias("members"))
    cost = of_list.groupBy("cluster").agg(F.sum(F.col("members") * F.col("members")).alias("apart"))
    nodes = rows.select("fp", "n").distinct().join(of_node, F.col("fp") == F.col("node")).select("fp", "n", F.col("label").alias("cluster"))
    sizes = nodes.groupBy("cluster").agg(F.count("*").cast("double").alias("nodes"), F.sum("n").alias("hashes"))
    chosen = sizes.join(cost, "cluster").where(F.col("nodes") * F.col("nodes") <= F.col("apart"))
    chosen = scratch.save(chosen.select("cluster", F.ceil(F.col("hashes") / CLUSTER_BLOCK).cast("int").alias("blocks")), "chosen")
    return nodes.join(chosen, "cluster").select("fp", "cluster", "blocks"), of_list.join(chosen, "cluster", "left_anti").select("value")


def meeting(rows: DataFrame, k: int | None, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of (value, fp, n, label, sketch, own, blocks) that meet under a value and may be similar enough.

    own: the values that a node is listed under; a pair is looked at under the least that both
    have, once. Null: under every value. A list of several blocks is cut by a hash of fp, and
    each two blocks are compared in a task of their own, so that no task holds a long list.
    k: see compare.
    """
    blocks = F.col("blocks")
    cut = rows.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            _, i, j = place
            held.sort(key=lambda r: r[4])  # those of block i first
            fps, n, labels, own, block, sketches = zip(*held, strict=True)
            left = None if i == j else sum(b == i for b in block)
            own = [set(o) if o is not None else None for o in own]
            here = lambda x, y: own[x] is None or own[y] is None or min(own[x] & own[y]) == place[0]
            pairs = [tuple(sorted((fps[x], fps[y]))) for x, y in compare(np.array(n), labels, sketches, k, num, den, here, left)]
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.binary()) for c in (0, 1)], names=["a", "b"])

        place = None
        for batch in batches:
            sketch = batch.column(8)
            offsets, flat = np.asarray(sketch.offsets), np.asarray(sketch.values)
            for r, (v, i, j, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True)):
                if (v, i, j) != place and held:
                    yield flush()
                    held = []
                place = v, i, j
                held.append((*row, flat[offsets[r] : offsets[r + 1]]))
        if held:
            yield flush()

    dealt = cut.select("value", "i", "j", "fp", "n", "label", "own", "block", "sketch").repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 5, num: int = 80, den: int = 100, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, stays), one row per document.

    stays: whether this is the one document of its component that a filter keeps, the first by
    doc_id (nulls last), then text_hash; rows of equal doc_id and text have it in common.
    """
    o = least_shared(num / den, k)
    sets = scratch.save(sketches(docs, words, k), "sketches")
    by_fp = sets.where(F.col("fp").isNotNull()).groupBy("fp")
    nodes = scratch.save(by_fp.agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("pick"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    # Sets of at most k shingles are their own sketch, and so is any set similar to one of at most small.
    small = k * num // den
    of_both = F.ceil(F.col("n") * num / F.lit(den)).cast("int")
    shared = F.when(F.col("n") <= small, of_both).otherwise(F.lit(o))
    values = nodes.select("fp", "n", (F.size("sketch") - shared + 1).alias("m"), F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    listed = scratch.save(listing(values).select("value", "fp", "n", "place"), "lists")
    # At most k values a node; a pair is compared in the least list that both are in.
    shelves = scratch.save(listed.groupBy("fp").agg(F.collect_list("value").alias("own")), "shelves")
    wanted = listed.select("fp").distinct().join(nodes, "fp").select("pick.doc_id", "pick.text_hash", "fp")
    full = scratch.save(full_sets(docs, wanted, words), "sets")
    rarest = F.row_number().over(W.partitionBy("fp").orderBy("place")) <= VOTES
    votes = listed.withColumn("rarest", rarest).where("rarest").select("value", "fp")
    edges = scratch.save(confirm(stars(votes, 0), full, num, den), "stars")
    labels = scratch.save(connected_components(edges, scratch), "labels")

    def again(rows: DataFrame, seed: int) -> None:
        nonlocal edges, labels
        more = scratch.save(confirm(stars(rows, seed), full, num, den), "stars")
        edges = edges.unionByName(more)
        labels = scratch.save(connected_components(edges, scratch), "labels")

    in_blocks = F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")

    def widely(rows: DataFrame, lists: DataFrame) -> DataFrame:
        return rows.join(lists, "value").join(full.select("fp", F.slice("hashes", 1, WIDE).alias("sketch")), "fp").select("value", "fp", "n", "label", "sketch", "own", in_blocks)

    def gathered(rows: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of the clusters of some lists, and the lists that stay by themselves."""
        held = scratch.save(rows.join(lists, "value").select("value", "fp", "n", "label", "members"), "long")
        of_node, apart = clusters(held.select("value", "fp", "n", "members"), scratch)
        whole = of_node.join(held.select("fp", "n", "label").distinct(), "fp").join(full.select("fp", F.col("hashes").alias("sketch")), "fp")
        whole = whole.select(F.col("cluster").alias("value"), "fp", "n", "label", "sketch", F.lit(None).cast("array<long>").alias("own"), "blocks")
        return scratch.save(meeting(whole, None, num, den).distinct(), "gathered"), lists.join(apart, "value", "left_semi")

    # Nodes of long lists that are still open are listed under their full sets' rarest shingles:
    # an exact filter, and one that shared lines and passages hardly pass.
    named, still = open_lists(listed, labels)
    long = named.join(still.where(F.col("members") > LONG), "value", "left_semi").select("fp", "n").distinct()
    whole = full.join(long, "fp").select("fp", "n", (F.col("n") - of_both + 1).alias("m"), F.col("n").cast("int").alias("size"), F.explode("hashes").alias("value"))
    deep = scratch.save(listing(whole).select("value", "fp", "n"), "deep")
    found = []
    if not deep.isEmpty():
        named, still = open_lists(deep, labels)
        again(named.join(still, "value", "left_semi"), 1)
        named, still = open_lists(deep, labels)
        near, apart = gathered(named, still)
        found += [near, meeting(widely(named.withColumn("own", F.lit(None).cast("array<long>")), apart), WIDE, num, den)]
    named, still = open_lists(listed, labels)
    near, apart = gathered(named, still.where(F.col("members").between(SHORT + 1, LONG)))
    if not near.isEmpty():
        # Links of clusters close lists, so that fewer are left to compare.
        edges = edges.unionByName(scratch.save(confirm(near, full, num, den), "stars"))
        labels = scratch.save(connected_components(edges, scratch), "labels")
        apart = scratch.save(apart, "apart")
        named, still = open_lists(listed, labels)
        apart = still.join(apart.select("value"), "value", "left_semi")
    named = named.join(shelves, "fp")
    found.append(meeting(widely(named, apart), WIDE, num, den))
    short = named.join(still.where(F.col("members") <= SHORT), "value").join(nodes.select("fp", "sketch"), "fp").withColumn("blocks", F.lit(1))
    pairs = meeting(short, k, num, den)
    for more in found:
        pairs = pairs.unionByName(more)
    pairs = pairs.distinct()
    links = scratch.save(confirm(pairs, full, num, den), "links")
    labels = scratch.save(connected_components(edges.unionByName(links), scratch), "labels")

    final = nodes.select("fp", "pick").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    roots = final.groupBy("label").agg(F.min("pick").alias("head"))
    of_node = final.join(roots, "label").select("fp", "head")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    grouped = sets.where(F.col("fp").isNotNull()).join(of_node, "fp").select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), "text_hash", first.alias("stays"))
    alone = sets.where(F.col("fp").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("stays"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return scratch.finish(grouped.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", "stays"))
