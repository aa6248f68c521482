"""Session, table and scratch-table helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("vellum")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path is only ever opened by Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset on a single machine, a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


#: Removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive the loss of executors.

    `save` writes a DataFrame once and returns it reread; `drop` removes tables that no later
    step reads, so that an iterative operator holds two generations at most.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/vellum-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.saved: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.folder(label)
        # A written table needs its shuffles no more; else they stay until the driver collects garbage.
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        out = self.spark.read.schema(nullable(df.schema)).parquet(path)
        self.saved.append((out, path))
        return out

    def folder(self, label: str) -> str:
        """A new folder under the scratch root; also for files that are not Parquet tables."""
        self.n += 1
        return f"{self.root}/{self.n:04d}-{label}"

    def drop(self, *frames: DataFrame) -> None:
        gone = [path for frame, path in self.saved if any(frame is f for f in frames)]
        self.saved = [(frame, path) for frame, path in self.saved if path not in gone]
        self._delete(gone)

    def _delete(self, paths: list[str]) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def finish(self, df: DataFrame, label: str = "result", folders: Iterable[str] = ()) -> DataFrame:
        """Save an operator's result and drop all its other tables, and the folders named."""
        out = self.save(df, label)
        self.drop(*[frame for frame, _ in self.saved if frame is not out])
        self._delete(list(folders))
        return out
