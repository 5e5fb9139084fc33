"""Session helpers: reading tables, and keeping results in storage that every executor shares."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset on one machine (tests), a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="quillgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: survives lost executors, and later plans start from it. The shuffle
    files that led to it go at once, rather than when the driver happens to collect its garbage."""
    checkpoint_dir(df.sparkSession)
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint(eager=True)  # a new plan, made under the setting


#: Rows of a few whole numbers are a tenth as large when shuffled as in a task that aggregates them: some 1,500,000 rows.
_ADVISORY, _SHUFFLED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"


class Rounds:
    """Tables of the rounds of a loop, written to the shared folder as Parquet. What a checkpoint knows of its size is an
    estimate, which joins multiply from round to round; a written table's size is what it is. Gone after clear()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{checkpoint_dir(spark)}/rounds/{uuid.uuid4().hex}", 0
        self.names: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), _setting(self.spark, _ADVISORY, _SHUFFLED):
            df.select("*").write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dealt(self, df: DataFrame, by: str, apart: str, parts: int) -> DataFrame:
        """Bucketed by a column, so that joins on it read it without a shuffle, and in folders by another of few values.
        Spark knows buckets of named tables only, so that it has a name until clear()."""
        self.made += 1
        name = f"rounds_{uuid.uuid4().hex}"
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), _setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "8"):
            write = df.repartition(parts, by).write.partitionBy(apart).bucketBy(parts, by)
            write.format("parquet").option("path", f"{self.folder}/{self.made}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def clear(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_MANY_FILES = 200


def fingerprint(*tables: DataFrame) -> str | None:
    """A hash of the files that tables are read from: names, sizes and times of change. None if a table has no files."""
    found: list[tuple[str, int, object]] = []
    for df in tables:
        files, spark = df.inputFiles(), df.sparkSession
        if not files:
            return None
        if len(files) > _MANY_FILES:  # asked for by tasks
            seen = spark.read.format("binaryFile").load(files).select("path", "length", F.unix_micros("modificationTime"))
            found += [tuple(r) for r in seen.collect()]
            continue
        for name in files:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            found.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def kept_folder(spark: SparkSession, name: str, made_of: list[DataFrame], write: Callable[[str], object]) -> str:
    """A folder of the shared one, which `write` fills once in a session for a state of the tables `made_of`."""
    version = fingerprint(*made_of)
    key = (spark.sparkContext.applicationId, name, version or uuid.uuid4().hex)
    if key not in _kept:
        path = f"{checkpoint_dir(spark)}/kept/{hashlib.sha256('\n'.join(key).encode()).hexdigest()[:24]}"
        write(path)
        _kept[key] = path
    return _kept[key]


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], made_of: list[DataFrame], write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """A table that is built once in a session and written to the shared folder, as Parquet; later plans read it, with
    their filters and columns pushed down. It is built anew when the files of the tables that it is `made_of` change (or
    each time, if they have none). `write`: how, if not as it comes."""
    put = write or (lambda df, path: df.write.mode("overwrite").parquet(path))
    return spark.read.parquet(kept_folder(spark, name, made_of, lambda path: put(build(), path)))


def kept_already(spark: SparkSession, name: str, made_of: list[DataFrame]) -> DataFrame | None:
    """The table that kept() has built in this session, if it has, and the files of the tables are as they were."""
    path = _kept.get((spark.sparkContext.applicationId, name, fingerprint(*made_of) or ""))
    return spark.read.parquet(path) if path else None


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, plans that run send Python batches of at most so many rows: for rows of many kilobytes."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield
