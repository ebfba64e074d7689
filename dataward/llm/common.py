"""What the corpus operators share: tables, cut lineage, words and safe numbers of partitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables that this process has written to cut lineage.
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a session of one process and without one gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark's setting for removing the files of a query's shuffles as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """The files of shuffles that are made meanwhile go once their query ends; else they are all kept."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors take nothing along."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with tidied(df.sparkSession):
        df.write.parquet(path)
    _tables.append(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.written_to = path
    return table_


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(table_: DataFrame) -> None:
    """Removes a table as written() returned it, once nothing reads it any more."""
    _remove(table_.sparkSession, table_.written_to)
    _tables.remove(table_.written_to)


def clear(spark: SparkSession) -> int:
    """Removes the tables that operators have written so far, once their results are saved; how many there were."""
    n = len(_tables)
    while _tables:
        _remove(spark, _tables.pop())
    return n


def unused(df: DataFrame, name: str) -> str:
    """name, or if df has such a column, name after underscores."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most rows of whole texts that pass between Spark and Python at once.
BATCH_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """df, once its session hands texts to Python in batches of BATCH_ROWS at most: texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, the first by a hash of keys, so the same on each run.

    A cut-off on the hash, from the number of rows, leaves little more than n rows to put in order.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(2**32))
    share = (1.2 * n + 1000) / max(df.count(), 1)
    df = df.where(place < int(share * 2**32)) if share < 1 else df
    return df.orderBy(place, *keys).limit(n)


def arrow_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of whole texts, A-Z lower-cased: (distinct words, all words as indices into them, words in each text); null is empty."""
    # Arrow's lower-casing misreads large strings that begin inside a batch, so they are copied first.
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    lengths = np.asarray(split.value_lengths(), np.int64)
    flat = split.flatten()
    filled = np.asarray(pc.binary_length(flat), np.int64) > 0
    lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[filled], minlength=len(lengths))
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, np.int64), lengths
