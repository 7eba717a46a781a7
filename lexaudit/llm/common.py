"""Small numpy helpers, joins of hot keys and settings of the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import FILE_ROWS, Scratch, shared_dir  # noqa: F401

#: Rows and bytes of one Arrow batch handed to a Python worker; both bound its memory and the JVM's buffers.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: Keys are hot with so many rows in a sample of one in SAMPLED sources; the hottest so many are treated as such.
SAMPLED, HOT, HOT_KEYS = 64, 1024, 50_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get.

    Plans read these two settings when they run, so they stay set in the session. They change no
    result; no function of this package relies on how batches are cut.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """Give a Python worker's unused memory back: it may wait or do other work next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lens[i]-1 for every i, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def slices(batch, columns: list[str], most: int = 4 << 20):
    """Slices of an Arrow batch whose named binary or string columns have about so many bytes, one row at least."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (a multiply-xorshift finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs whose results are in tables now."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def narrowed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined with the rows of `wanted` (doc_id, ...), a table that was kept, by doc_id; null ids join nothing.

    Spark may filter the scan of docs by a Bloom filter of the ids (of bounded size, and only while
    they are few) before it shuffles texts. It does so for a side with a comparison on it: this one
    holds for every id.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1b")
    return docs.join(wanted.where(F.col("doc_id") >= F.lit(-(1 << 63))), "doc_id")


def with_first(rows: DataFrame, sample: DataFrame, order: list[str], scratch: Scratch, label: str) -> DataFrame:
    """rows (key, ...) of keys with several rows, with p_<c> for each c of `order`: those of the key's first row by `order`.

    A running first needs no buffer, however many rows share a key. Yet a key's rows meet in one
    task, so hot keys go another way: `sample` holds the rows of one in SAMPLED sources, and keys
    with HOT rows of it or more (HOT_KEYS at most, which bounds what is broadcast) get their first
    row from an aggregate that is combined before it is shuffled. Which keys are hot affects the
    cost alone, not the result.
    """
    hot = sample.groupBy("key").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "key").limit(HOT_KEYS).select("key")
    hot = scratch.keep(hot, f"{label}-hot", HOT_KEYS)
    w = W.partitionBy("key").orderBy(*order)
    first = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    firsts = lambda df: df.withColumns({f"p_{c}": F.first(c).over(first) for c in order} | {"_k": F.row_number().over(w), "_next": F.lead("key").over(w)}).where("_k > 1 or _next is not null").drop("_k", "_next")
    if not hot.limit(1).count():
        return firsts(rows)
    some = rows.join(F.broadcast(hot), "key").groupBy("key").agg(F.min(F.struct(*order)).alias("p"))
    some = scratch.keep(some, f"{label}-hot-first", HOT_KEYS)
    own = rows.join(F.broadcast(some), "key").select(*rows.columns, *(F.col("p")[c].alias(f"p_{c}") for c in order))
    return firsts(rows.join(F.broadcast(hot), "key", "left_anti")).unionByName(own)


def sampled(source: DataFrame, node: Column) -> DataFrame:
    """One in SAMPLED rows, by a hash of `node`."""
    return source.where(F.pmod(F.xxhash64(F.lit(9), node), F.lit(SAMPLED)) == 0)


def blocked(rows: DataFrame, key: str, node: Column, scratch: Scratch, label: str, block: int = 1024) -> DataFrame:
    """rows (of a kept table) with cell and side, so that two rows of a key meet in exactly one cell.

    A key of up to `block` rows is one cell, -1. A larger one is dealt into blocks by a hash of
    `node`, and its pairs into cells of two blocks: no task gets a key whole. Pairs of a cell are
    rows of side 0 with rows of side 1; in cells of one block (negative) all rows are side 2, and
    each pair is to be taken once.
    """
    large = scratch.keep(rows.groupBy(key).count().where(F.col("count") > block).select(key, F.ceil(F.col("count") / block).cast("int").alias("blocks")), f"{label}-large")
    rows = rows.join(large, key, "left").withColumn("own", F.pmod(F.xxhash64(F.lit(8), node), F.coalesce("blocks", F.lit(1))).cast("int"))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(2).alias("side")))
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.when(x == F.col("own"), F.struct((-2 - x).cast("long").alias("cell"), F.lit(2).alias("side"))).otherwise(
            F.struct((F.least(x, F.col("own")).cast("long") * F.col("blocks") + F.greatest(x, F.col("own"))).alias("cell"), (F.col("own") > x).cast("int").alias("side"))
        ),
    )
    return rows.select("*", F.inline(F.when(F.col("blocks").isNull(), whole).otherwise(cells))).drop("blocks", "own")
