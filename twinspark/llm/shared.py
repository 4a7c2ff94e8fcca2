"""What the text operators share: Arrow batches cut by bytes, words, lineage cuts, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.operators.similar import checkpoint_folder

#: Bytes of text that one vectorised step holds; a single longer text is a step of its own.
STEP_BYTES = 2 << 20
#: ASCII white space, the only characters that separate words.
BLANKS = r"[\x20\x09-\x0D]"


def _checkpoints(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir; one of our own only if none is set and all tasks run on this machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_folder(context.getConf().get("spark.checkpoint.dir"), context.master))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> DataFrame:
    """`df` with a number of each row, _row; written, so that the numbers stay."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def steps(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds at most `max_bytes` of `column`, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    release()


def release() -> None:
    """Give memory that nothing uses back to the system: workers live on, and the next operator's tasks need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as strings, null as the empty text."""
    return pc.fill_null(batch.column(column), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words, each word's code, and the distinct words by code."""
    lists = pc.ascii_split_whitespace(texts)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=offsets[1:])
    empty = pc.index(encoded.dictionary, pa.scalar("", encoded.dictionary.type)).as_py()
    if empty >= 0:  # leading or trailing white space
        real = codes != empty
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(real, out=before[1:])
        codes, offsets = codes[real], before[offsets]
    return offsets, codes, encoded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hashed(strings: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    from pandas.util import hash_array

    return hash_array(np.asarray(strings.to_pylist(), dtype=object), categorize=False)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], zero for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out anew if its files give fewer partitions than there are cores: a small table in one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node that has an edge, with the smallest node it is connected to.

    Alternates large-star and small-star steps until the edges no longer change; every step is
    an aggregation and a join on nodes, and each round is cut at the shared folder.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now = cut_lineage(now)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        now = cut_lineage(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def bounded_labels(docs: DataFrame, labels: DataFrame, learns, label: str, rows: int, text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled rows where `learns` holds: the smallest hashes of ids.

    Rows without an id or a label, and ids with labels that differ, are not learned from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learns)
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("most")).where("label = most").drop("most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias(text)).join(F.broadcast(known), "doc_id")
