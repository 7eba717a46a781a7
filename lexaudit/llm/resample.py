"""Operator 3: quality classification by importance resampling.

Two generative models of hashed word uni- and bigrams, one of target texts and one of raw texts,
give each document the log-ratio of its probabilities as importance weight. Adding Gumbel noise
(from a hash of the id, so reruns agree) and keeping the largest keys samples without replacement
in proportion to the weights. Raw counts are taken over all documents; the target documents are a
bounded sample of the labelled ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import by_bytes
from .common import Scratch, load, mix, release, tune
from .shingles import word_hashes

BUCKETS = 1 << 14
#: Labelled target documents that the target model reads at most.
TARGETS = 20_000
#: Share of the documents that is kept.
SHARE = 0.8
SMOOTHING = 1.0


def gram_buckets(words: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    if not len(words):
        return np.zeros(0, np.int64)
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return (np.concatenate([words, pairs]) % np.uint64(buckets)).astype(np.int64)


def models(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, targets: int = TARGETS) -> np.ndarray:
    """Log-ratio of target to raw probability of each bucket."""
    spark = docs.sparkSession
    tune(spark)
    some = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("id")).where("id is not null").distinct()
    ids = np.sort(np.array([r.id for r in some.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(targets).collect()], np.int64))
    told = spark.sparkContext.broadcast(ids)

    def run(batches):
        counts, ids = np.zeros((2, buckets), np.int64), told.value
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in by_bytes(texts):
                for i, words in zip(own[a:b], word_hashes(texts[a:b])):
                    n = np.bincount(gram_buckets(words, buckets), minlength=buckets)
                    counts[0] += n
                    if i is not None and len(ids) and ids[min(np.searchsorted(ids, i), len(ids) - 1)] == i:
                        counts[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])
        release()

    sums = docs.select("doc_id", "text").mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums.collect():  # a row a bucket
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    log = lambda c: np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * buckets)
    return log(target) - log(raw) if target.any() else np.zeros(buckets)


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, noise, n_grams and log_weight of every row of (doc_id, text, noise)."""
    told = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        ratio = told.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, w = [], []
            for a, b in by_bytes(texts):
                for words in word_hashes(texts[a:b]):
                    grams = gram_buckets(words, len(ratio))
                    n.append(len(grams))
                    w.append(float(ratio[grams].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("noise"), pa.array(n, pa.int64()), pa.array(w, pa.float64())], ["doc_id", "noise", "n_grams", "log_weight"])
        release()

    return docs.select("doc_id", "text", "noise").mapInArrow(run, "doc_id long, noise long, n_grams long, log_weight double")


def resample(docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = 3, k: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, gumbel_key, rank (from 1) and selected (rank <= k).

    k is share times the number of rows unless given. Null and empty texts have weight 0. The noise
    is a hash of the id, or of the text where there is no id, so rows that repeat an id share it. Ties
    go by doc_id, then number of grams; a null id comes after the others of its key. No target
    documents make a uniform sample; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("noise", F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))))
    scored = weigh(docs, models(docs, target_ids))
    uniform = (F.shiftrightunsigned("noise", 12) + 0.5) / float(1 << 52)
    scored = scratch.keep(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))).drop("noise"), "scored")
    k = round(share * scored.count()) if k is None else k
    # ranks without a single task: places in range partitions, and a prefix sum over the partitions
    order = [F.desc("gumbel_key"), F.asc_nulls_last("doc_id"), F.asc("n_grams")]
    placed = scratch.keep(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"part": part, "place": place})
    sizes = placed.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(before, "part").select("doc_id", "n_grams", "log_weight", "gumbel_key", rank.alias("rank"), (rank <= k).alias("selected"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
