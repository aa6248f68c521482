"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1], linear between a start and an
end weight; its integral is the source's weight. The integrated weights give every source a
token target (water-filled: no source above `max_passes` times its own size). The documents of
a source stand in a fixed pseudo-random order; a document's place in that order is a cumulative
token demand, and inverting the integrated schedule turns the demand into a training position.
`mix` range-sorts the document occurrences by position.

Prefix sums never put a source into one task: documents fall into (source, bucket) groups by
the first digits of a hash of doc_id, sums run within the groups, and the groups' own totals
(a few thousand rows a source) give each group its offset.

Cases: a null text has size 0; a null source is a source of its own, last in order; a null
doc_id hashes like the word `null`; rows that repeat a doc_id keep apart (identical rows are
interchangeable); an empty table gives no rows; other columns of the input pass through `mix`,
and the columns added here replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights repeat over the sources in order; a schedule is (start, end) as a
#: multiple of the weight, of mean 1, so that its integral over time is the weight.
WEIGHTS = (3, 1, 2)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, h, text_hash): what mixing needs of a document; the text is read once."""
    h = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        h.alias("h"),
        F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_pct: int = 150, max_passes: int = 2) -> DataFrame:
    """One row per source: its size, weight, schedule and water-filled target.

    Sharing by weight, capping at max_passes times the size and resharing the excess ends at
    min(cap, level * weight) with one level for all sources; sources sorted by cap / weight are
    capped up to some place, so prefix sums find the level without iterating.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    i = F.row_number().over(order) - 1
    per = per.withColumn("i", i)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("i") % len(values) + 1).cast("int"))
    per = per.withColumn("weight", pick(weights)).withColumn("cap", F.col("source_size") * max_passes)
    start, end = zip(*SCHEDULES, strict=True)
    per = per.withColumn("w_start", pick(start)).withColumn("w_end", pick(end))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "i")
    everyone = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(everyone) * F.lit(share_pct) / F.lit(100.0)
    # The level if everything before this row is capped and this row and all after it are not.
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # The first row that then stays under its cap gives the level of all that follow.
    per = per.withColumn("place", F.row_number().over(by_ratio))
    fits = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    level = F.min(fits).over(everyone)["level"]
    target = F.when(level.isNull() | (F.col("cap") <= level * F.col("weight")), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return per.select("source", "source_size", "weight", "w_start", "w_end", target.alias("target"))


def invert_schedule(start: Column, end: Column, f: Column) -> Column:
    """The time t at which a schedule linear from start to end has used the fraction f of its integral."""
    slope = end - start
    area = (start + end) / 2
    # start t + slope t^2 / 2 = f area; the stable root also holds for slope 0.
    return F.least(F.lit(1.0), 2 * f * area / (start + F.sqrt(start * start + 2 * slope * f * area)))


def assign_positions(sizes: DataFrame, buckets: int = 4096, max_passes: int = 2, **plan) -> DataFrame:
    """sizes (of `sized`, stored: it is read three times) plus source_size, target, taken and positions.

    taken: the words the mix takes of the document over all passes; a source's sum is its
    rounded target. The document at the end of the last pass is taken in part. positions: one
    training position for each pass that takes words of the document.
    """
    digits = 1
    while 16**digits < buckets:
        digits += 1
    key = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    rows = sizes.withColumn("b", F.substring("h", 1, digits)).withColumn("sk", key[0]).withColumn("sn", key[1])
    groups = rows.groupBy("sk", "sn", "b").agg(F.sum("size").alias("group_size"))
    prior = W.partitionBy("sk", "sn").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("sk", "sn", "b", F.coalesce(F.sum("group_size").over(prior), F.lit(0)).alias("offset"))
    per = targets(sizes, max_passes=max_passes, **plan).withColumn("sk", key[0]).withColumn("sn", key[1]).drop("source")
    groups = groups.join(per, ["sk", "sn"])
    within = W.partitionBy("sk", "sn", "b").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(groups, ["sk", "sn", "b"])
    begin = F.col("offset") + F.col("upto") - F.col("size")
    goal = F.floor(F.col("target") + 0.5)
    part = lambda p: F.least(F.greatest(goal - p * F.col("source_size") - begin, F.lit(0)), F.col("size"))
    parts = [part(p) for p in range(max_passes)]
    place = lambda p: invert_schedule(F.col("w_start"), F.col("w_end"), (begin + p * F.col("source_size")) / F.col("target"))
    occurrences = F.filter(
        F.array(*[F.struct(F.lit(p + 1).alias("mix_pass"), parts[p].cast("long").alias("take_words"), F.when(F.col("target") > 0, place(p)).alias("position")) for p in range(max_passes)]),
        lambda o: o["take_words"] > 0,
    )
    taken = parts[0]
    for p in parts[1:]:
        taken = taken + p
    return rows.select("doc_id", "source", "size", "h", "text_hash", "source_size", "target", taken.cast("long").alias("taken"), occurrences.alias("occurrences"))


def mix(docs: DataFrame, assigned: DataFrame, partitions: int | None = None) -> DataFrame:
    """The documents' occurrences with mix_pass, take_words and position, range-sorted by position.

    Joins on doc_id, source and the text's hash; rows that agree in these are matched by rank.
    """
    own = ("mix_pass", "take_words", "position")
    docs = docs.drop(*[c for c in docs.columns if c in own or c.startswith("_mix")])
    on = ["_mix_id", "_mix_text", "_mix_src"]
    source = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    left = docs.withColumns({"_mix_id": doc_id, "_mix_text": F.xxhash64(F.col("text").cast("string")), "_mix_src": source(F.col("source")), "_mix_tie": F.lit(0)})
    right = assigned.select(doc_id.alias("_mix_id"), F.col("text_hash").alias("_mix_text"), source(F.col("source")).alias("_mix_src"), F.col("taken").alias("_mix_tie"), "occurrences")
    ranked = lambda df: df.withColumn("_mix_rank", F.row_number().over(W.partitionBy(*on).orderBy("_mix_tie")))
    both = ranked(left).join(ranked(right).drop("_mix_tie"), [*on, "_mix_rank"])
    out = both.select(*docs.columns, F.explode("occurrences").alias("_mix_o")).select(*docs.columns, "_mix_o.*")
    by = [F.col("position"), F.col("doc_id"), F.col("mix_pass")]
    out = out.repartitionByRange(partitions, *by) if partitions else out.repartitionByRange(*by)
    return out.sortWithinPartitions(*by)
