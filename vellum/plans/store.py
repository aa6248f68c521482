"""Snapshot store: immutable Parquet folders and a manifest that names the current ones.

Parquet has no transactions, so a commit writes new folders and then one small manifest
version; readers resolve the newest manifest once and see all tables as of it. A table may be
several folders: an ingest appends what its documents need, whatever the store's size, and
lists the snapshots that retire; readers leave these out. `vacuum` rewrites a table as one
folder and deletes what no manifest names. Two writers cannot publish the same generation: the
second finds the first's lock and is told that the store is busy. The driver handles file
names and counts, never rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vellum.functions import scalars

FAILURES_KEPT = 50


def add_redirects(redirects: DataFrame, new: DataFrame) -> DataFrame:
    """old_id -> new_id with chains cut short: earlier redirects to a replaced id now point past it."""
    moved = new.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_to"))
    kept = redirects.join(moved, "new_id", "left").select("old_id", F.coalesce("_to", "new_id").alias("new_id"))
    return kept.join(new.select("old_id"), "old_id", "left_anti").unionByName(new)


def upsert(current: DataFrame, incoming: DataFrame, key: str, content_hash: str) -> tuple[DataFrame, DataFrame]:
    """(table, counts of inserted, updated, unchanged): rows replaced only where their hash differs."""
    a, b = current.alias("a"), incoming.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    state = F.when(F.col(f"a.{key}").isNull(), F.lit("inserted")).when(F.col(f"b.{key}").isNull(), F.lit("kept")).when(F.col(f"a.{content_hash}") == F.col(f"b.{content_hash}"), F.lit("unchanged")).otherwise(F.lit("updated"))
    marked = both.withColumn("_state", state)
    pick = [F.when(F.col("_state").isin("inserted", "updated"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in current.columns]
    return marked.select(*pick), marked.groupBy("_state").agg(F.count("*").alias("n"))


def replace_by(current: DataFrame, incoming: DataFrame, key: str = "rfc") -> DataFrame:
    """All rows of the incoming keys replaced."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def failures(current: DataFrame, new: DataFrame, kept: int = FAILURES_KEPT) -> DataFrame:
    """The newest failures; messages are cut at 500 characters."""
    rows = current.unionByName(new.withColumn("message", F.substring("message", 1, 500)))
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(kept)


def fresh(incoming: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Documents whose snapshot id is not stored yet."""
    return incoming.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti")


def orphans(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    return rows.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti")


#: The layout of the stored tables; readers fill in what folders of an earlier one lack.
LAYOUT = 2
# Columns that later layouts added, with the value that earlier rows have.
ADDED = {"snapshots": {"metadata_hash": ""}, "counters": {"warnings": None}, "postings": {"positions": None}}
#: Tables that hold rows of snapshots, by the column that names the snapshot.
BY_SNAPSHOT = {"snapshots": "id", **dict.fromkeys(("sections", "blocks", "mentions", "requirements", "references", "citations", "counters", "postings", "lengths"), "snapshot_id")}


class StoreBusy(Exception):
    """Another writer has published the generation that this one was to become."""


class Store:
    """Tables under `root`, each in folders; manifests list (table, path, layout) for a generation."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def generation(self) -> int:
        fs, path = self._fs()
        folder = path(f"{self.root}/manifest")
        if not fs.exists(folder):
            return 0
        # A manifest counts once its writer has put its success mark.
        names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return max((int(n[1:]) for n in names if fs.exists(path(f"{self.root}/manifest/{n}/_SUCCESS"))), default=0)

    def manifest(self) -> dict[str, list[tuple[str, int]]]:
        """The folders of each table, with the layout that each was written in."""
        g, out = self.generation(), {}
        for r in self.spark.read.parquet(f"{self.root}/manifest/g{g}").orderBy("place").collect() if g else []:
            out.setdefault(r["table"], []).append((r["path"], r["layout"]))
        return out

    def read(self, name: str) -> DataFrame | None:
        """A table's live rows: those of retired snapshots are left out."""
        now = self.manifest()
        if name not in now:
            return None
        df = self._folders(name, now[name])
        if name in BY_SNAPSHOT and "retired" in now:
            key = BY_SNAPSHOT[name]
            df = df.join(self._folders("retired", now["retired"]).select(F.col("id").alias(key)).distinct(), key, "left_anti")
        return df

    def _folders(self, name: str, folders: list[tuple[str, int]]) -> DataFrame:
        out = None
        for layout in sorted({n for _, n in folders}):
            part = self.spark.read.parquet(*[f"{self.root}/{p}" for p, n in folders if n == layout])
            for column, value in ADDED.get(name, {}).items() if layout < LAYOUT else ():
                if column not in part.columns:
                    part = part.withColumn(column, F.lit(value))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def commit(self, tables: dict[str, DataFrame], append: bool = False, base: int | None = None) -> int:
        """Write the tables' folders, then publish them together; the new generation.

        append: the folders join those that are there. base: the generation that the tables
        were made from, if it was read before.
        """
        g = (self.generation() if base is None else base) + 1
        now = self.manifest()
        written = {name: f"{name}/v{g}-{uuid.uuid4().hex[:8]}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{written[name]}")
        fs, path = self._fs()
        if not fs.createNewFile(path(f"{self.root}/manifest/g{g}.lock")):
            for folder in written.values():
                fs.delete(path(f"{self.root}/{folder}"), True)
            raise StoreBusy(f"generation {g} is another writer's")
        for name, folder in written.items():
            now[name] = [*(now.get(name, []) if append and name in BY_SNAPSHOT else []), (folder, LAYOUT)]
        rows = [(name, folder, layout, i) for name in sorted(now) for i, (folder, layout) in enumerate(now[name])]
        self.spark.createDataFrame(rows, "table string, path string, layout int, place int").coalesce(1).write.parquet(f"{self.root}/manifest/g{g}")
        return g

    def derive(self, docs: DataFrame) -> dict[str, DataFrame]:
        """All tables of documents (rfc, snapshot_id, raw, metadata_hash); the parsed form is staged, as each table reads it."""
        from vellum.operators import normative, references, search, structure

        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        structure.parse_documents(docs.select("rfc", "snapshot_id", "raw")).write.parquet(staged)
        parsed = self.spark.read.parquet(staged)
        sections, blocks = structure.sections(parsed), structure.blocks(parsed)
        found = normative.mentions(blocks, sections)
        listed = references.entries(blocks, sections)
        refs, sites = references.cited(listed, references.sites(blocks, sections))
        counters = parsed.select("snapshot_id", "quality", "warnings", "text_length").join(normative.coverage(blocks, sections), "snapshot_id", "left")
        own = docs.select(F.col("snapshot_id").alias("id"), "rfc", "raw", F.sha2("raw", 256).alias("raw_sha256"), "metadata_hash")
        keyed = blocks.select("snapshot_id", F.concat_ws("|", "snapshot_id", "id").alias("key"), "text")
        words = search.postings(keyed, "key", "text").withColumn("snapshot_id", F.substring_index("key", "|", 1))
        sizes = keyed.select("snapshot_id", F.size(search.tokenize("text")).alias("n")).where("n > 0").groupBy("snapshot_id").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_tokens"))
        # Sorted by token, so that a search reads only the parts that hold its tokens.
        words = words.repartitionByRange("token", "key").sortWithinPartitions("token", "key")
        return {"snapshots": own, "sections": sections, "blocks": blocks, "mentions": found, "requirements": normative.requirements(found), "references": refs, "citations": sites, "counters": counters, "postings": words, "lengths": sizes}

    def ingest(self, docs: DataFrame) -> int | None:
        """Parse, extract and publish new documents (rfc, raw, metadata_hash); the new generation, None if nothing is new.

        A document's older snapshots retire and redirects lead to the new id. A snapshot that
        had retired before is live again, without being parsed a second time.
        """
        from vellum.operators import normative, structure

        base, now = self.generation(), self.manifest()
        snap = scalars.snapshot_id("rfc", "raw", F.coalesce("metadata_hash", F.lit("")), structure.PARSER_VERSION, normative.EXTRACTOR_VERSION)
        incoming = docs.select("rfc", "raw", "metadata_hash").withColumn("snapshot_id", snap).dropDuplicates(["snapshot_id"])
        old = self.read("snapshots")
        new = fresh(incoming, old) if old is not None else incoming
        if new.isEmpty():
            return None
        if old is None:
            return self.commit(self.derive(new), base=base)
        retired = self._folders("retired", now["retired"]).select("id").distinct() if "retired" in now else self.spark.createDataFrame([], "id string")
        live = new.select("rfc", F.col("snapshot_id").alias("id"))
        gone = old.join(live.select("rfc").distinct(), "rfc", "left_semi").select("id", "rfc")
        pairs = gone.select(F.col("id").alias("old_id"), "rfc").join(live.select(F.col("id").alias("new_id"), "rfc"), "rfc").select("old_id", "new_id")
        redirects = self.read("redirects")
        none = self.spark.createDataFrame([], "old_id string, new_id string")
        changed = {
            "redirects": add_redirects((redirects if redirects is not None else none).join(live.select(F.col("id").alias("old_id")), "old_id", "left_anti"), pairs),
            "retired": retired.unionByName(gone.select("id")).join(live.select("id"), "id", "left_anti"),
        }
        unseen = new.join(retired.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti")
        return self.commit(self.derive(unseen) | changed, append=True, base=base)

    def reanalyze(self) -> int | None:
        """Derive every stored document again from its bytes; None if all ids stay, as they do unless a version has changed."""
        stored = self.read("snapshots")
        return None if stored is None else self.ingest(stored.select("rfc", "raw", "metadata_hash"))

    def reindex(self) -> int | None:
        """Make the postings and lengths of all live blocks anew."""
        from vellum.operators import search

        blocks = self.read("blocks")
        if blocks is None:
            return None
        keyed = blocks.select("snapshot_id", F.concat_ws("|", "snapshot_id", "id").alias("key"), "text")
        words = search.postings(keyed, "key", "text").withColumn("snapshot_id", F.substring_index("key", "|", 1))
        sizes = keyed.select("snapshot_id", F.size(search.tokenize("text")).alias("n")).where("n > 0").groupBy("snapshot_id").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_tokens"))
        return self.commit({"postings": words.repartitionByRange("token", "key").sortWithinPartitions("token", "key"), "lengths": sizes})

    def vacuum(self) -> int | None:
        """Rewrite each table without its retired rows, then delete every folder and manifest that the new one does not name."""
        if not self.generation():
            return None
        tables = {name: self.read(name) for name in self.manifest() if name != "retired"}
        tables["retired"] = self.spark.createDataFrame([], "id string")
        g = self.commit(tables)
        fs, path = self._fs()
        named = {folder for folders in self.manifest().values() for folder, _ in folders}
        for status in fs.listStatus(path(self.root)):
            table = status.getPath().getName()
            for version in fs.listStatus(status.getPath()):
                name = version.getPath().getName()
                if (table == "manifest" and name not in (f"g{g}", f"g{g}.lock")) or (table != "manifest" and f"{table}/{name}" not in named):
                    fs.delete(version.getPath(), True)
        return g
