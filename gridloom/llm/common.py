"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ASCII white space that separates words.
WORD_GAP = r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def whole_text(col: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col), F.lit(""))


def identity(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """(row bigint, tag int), which tell documents apart: the key and a hash of the text.

    So rows that share a key or have none stay apart, and rows equal in both count as one document. Unlike a
    row number it is the same in every job.
    """
    kind, whole = docs.schema[key].dataType, whole_text(text)
    number = F.col(key).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(key)
    return F.coalesce(F.when(F.col(key).isNotNull(), number), F.xxhash64(whole)).alias("row"), F.hash(whole).alias("tag")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in a local session one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


@contextmanager
def tidied(spark: SparkSession):
    """While it lasts, Spark removes the shuffle files of a query when the query ends."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)


_stored: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: smaller than a checkpoint for wide rows. release() removes it.

    The shuffle files of that job go when it is done, as nothing else can read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _stored.append((spark, path))
    with tidied(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df is computed once, into a table in the shared folder."""
    return stored(df, "cut")


def mark() -> int:
    """How many tables stored() has made so far."""
    return len(_stored)


def release(since: int = 0, *but: DataFrame) -> None:
    """Removes the tables that stored() made since that mark, except those of the frames `but`; for callers that have written what they need.

    At the end of the driver, those that are left go.
    """
    stay = {getattr(df, "stored_at", None) for df in but}
    _remove([x for x in _stored[since:] if x[1] not in stay])


def discard(*frames: DataFrame) -> None:
    """Removes the tables of these frames of stored(), which nothing reads any more."""
    gone = {getattr(df, "stored_at", None) for df in frames}
    _remove([x for x in _stored if x[1] in gone])


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for table in tables:
        _stored.remove(table)
        spark, path = table
        try:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
        except Exception:  # noqa: S112 - the session has ended; its folder is not ours to reach any more
            continue


atexit.register(release)


def fold(col: Column | str, parts: int) -> Column:
    """crc32 of the decimal text of an id, modulo parts."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string")) % parts


def chunks(lengths, most: int):
    """Splits rows into runs of at most `most` characters (or one longer row), as (start, end)."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the slices (start, length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents, chosen by a hash of doc_id among the allowed rows.

    The bound is what a model is fitted on; rows without a label are left out, and ids with labels that contradict each other. A repeated
    id counts once, with the least of its texts.
    """
    rows = labels.filter(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
    pick = rows.filter("low = high").select("doc_id", F.col("low").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # `most` rows at most, so the broadcast has a fixed bound.
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(pick), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def shared(spark: SparkSession, value):
    """A function that gives value on executors, through a broadcast; for values whose size has a fixed bound. Its forget() frees the broadcast.

    Pickled with the classes it needs, so executors need not have this package.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        return pickle.loads(sent.value)

    get.forget = sent.unpersist
    return get


def whole_groups(batches, most: int):
    """Arrow tables of whole groups, of rows clustered by their first column; about `most` rows at once, or one larger group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            differ = np.flatnonzero(key != key[-1])
            if len(differ):
                end = int(differ[-1]) + 1
                yield table.slice(0, end)
                held, rows = table.slice(end).to_batches(), len(key) - end
    if held:
        yield pa.Table.from_batches(held)
