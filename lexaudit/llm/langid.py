"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded sample of labelled rows (an even one of about SAMPLE rows by a
hash of id and text; each sampled text is read whole). All partitions count, and a shuffle sums
the counts by language and bucket; the driver gets the cells that have counts, whose number is
checked. The log-probability matrix is broadcast, and each batch is scored in numpy: hash every
n-gram, gather its row of the matrix, sum by text. Where the sample has more than LANGUAGES
languages, the matrix is held by its cells.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, load, ragged, release, tune

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that training reads at most.
SAMPLE = 20_000
#: Languages of a whole matrix at most; the model of more languages has its cells.
LANGUAGES = 64
#: Cells with counts that a model may have, 12 bytes each in every worker.
CELLS = 8 << 20
#: Characters that are hashed at once, and numbers that are gathered for them.
BLOCK, GATHERED = 1 << 20, 4 << 20
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def gram_buckets(codes: np.ndarray, buckets: int = BUCKETS):
    """(order, bucket of every n-gram) for each order."""
    x = codes.astype(np.uint32)
    for n in ORDERS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        yield n, (h % np.uint32(buckets)).astype(np.int64)


def coded(text: str) -> np.ndarray:
    """Lower-case code points between blanks."""
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(texts: list[str], block: int = BLOCK):
    """(code points, their texts): runs of texts, and long texts in blocks that overlap by the longest n-gram less one."""
    run, at, size = [], [], 0
    for i, t in enumerate(texts):
        c = coded(t)
        if len(c) > block:
            for k in range(0, len(c) - max(ORDERS) + 1, block):
                yield [c[k : k + block + max(ORDERS) - 1]], [i]
            continue
        run.append(c)
        at.append(i)
        size += len(c)
        if size > block:
            yield run, at
            run, at, size = [], [], 0
    if run:
        yield run, at


def text_sums(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over the n-grams of each text."""
    out, block = np.zeros((len(texts), table.shape[1])), max(1 << 12, min(BLOCK, GATHERED // max(1, table.shape[1])))
    for run, at in blocks(texts, block):
        codes, lens = np.concatenate(run), np.array([len(c) for c in run])
        first = np.cumsum(lens) - lens
        for n, b in gram_buckets(codes, len(table)):
            got = table[b]
            # in a block of a long text, grams that start in the overlap belong to the next block
            own = np.maximum(lens - n + 1, 0)
            if len(run) == 1 and len(codes) > block:
                own = np.minimum(own, block)
            for k in range(1, n):  # grams across two texts
                edge = first[1:] - k
                got[edge[(edge >= 0) & (edge < len(got))]] = 0
            if len(run) == 1:
                out[at[0]] += got[: own[0]].sum(axis=0)
            else:
                out[at] += np.add.reduceat(got, np.minimum(first, len(got) - 1), axis=0) * (own > 0)[:, None]
    return out


def text_counts(texts: list[str], buckets: int) -> np.ndarray:
    """How often each bucket has an n-gram of the texts."""
    out = np.zeros(buckets, np.int64)
    for run, _ in blocks(texts):
        codes, lens = np.concatenate(run), np.array([len(c) for c in run])
        first = np.cumsum(lens) - lens
        for n, b in gram_buckets(codes, buckets):
            keep = np.ones(len(b), bool)
            if len(run) == 1 and len(codes) > BLOCK:  # grams that start in the overlap belong to the next block
                keep[BLOCK:] = False
            for k in range(1, n):  # grams across two texts
                edge = first[1:] - k
                keep[edge[(edge >= 0) & (edge < len(b))]] = False
            out += np.bincount(b[keep], minlength=buckets)
    return out


class Cells(NamedTuple):
    """The matrix by its cells with counts: those of bucket b are start[b] .. start[b + 1] - 1."""

    start: np.ndarray
    lang: np.ndarray
    more: np.ndarray  # log-probability above that of a cell without counts
    least: np.ndarray  # by language, log-probability of a cell without counts
    prior: np.ndarray

    def sums(self, text: str) -> np.ndarray:
        """Log-probability of the text and each language."""
        n = text_counts([text], len(self.start) - 1)
        own = np.flatnonzero(n)
        size = self.start[own + 1] - self.start[own]
        at = ragged(self.start[own], size)
        return self.prior + n.sum() * self.least + np.bincount(self.lang[at], np.repeat(n[own], size) * self.more[at], len(self.prior))


def train(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, languages: int = LANGUAGES, cells: int = CELLS) -> tuple[list[str], np.ndarray | Cells]:
    """(languages, table of buckets x languages log-probabilities, with the log-priors in one more row).

    Learns from (doc_id, text, lang) where text and lang are there: all rows up to `sample` of them,
    or an even sample, of which each language with a letter in some text is learned. More than
    `languages` languages have Cells for a table; more than `cells` cells with counts are an error.
    Copies of a row are sampled together; an empty table gives an empty model.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    total = rows.count()
    # by hash: the bound holds up to the hash's evenness, and no sort of texts is needed
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(6), "doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * sample / total))

    def count(batches):
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(t):
                    by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                n = text_counts(texts, buckets)
                # one more bucket counts texts
                at = np.append(np.flatnonzero(n), buckets)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(np.append(n[at[:-1]], len(texts)), pa.int64())], ["lang", "bucket", "n"])
        release()

    scratch = Scratch(spark, "langid")
    sums = scratch.keep(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "sums")
    if sums.count() > cells:
        raise ValueError(f"the model would have more than {cells} cells: a smaller sample or fewer buckets are needed")
    got = sums.toArrow()
    scratch.drop("sums")
    name = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else None
    if name is None:
        return [], np.zeros((buckets + 1, 0))
    langs = sorted(name.dictionary.to_pylist())
    order = {x: i for i, x in enumerate(langs)}
    lang = np.array([order[x] for x in name.dictionary.to_pylist()])[name.indices.to_numpy()]
    at, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    is_text = at == buckets
    texts_of = np.bincount(lang[is_text], n[is_text], len(langs))
    lang, at, n = lang[~is_text], at[~is_text], n[~is_text]
    total_of = np.bincount(lang, n, len(langs))
    prior = np.log(texts_of + 1) - np.log(texts_of.sum() + len(langs))
    least = np.log(0.5) - np.log(total_of + 0.5 * buckets)
    more = np.log(n + 0.5) - np.log(0.5)
    if len(langs) > languages:
        by = np.lexsort((lang, at))
        start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=buckets))])
        return langs, Cells(start, lang[by].astype(np.int32), more[by], least, prior)
    table = np.tile(least, (buckets + 1, 1))
    table[at, lang] += more
    table[-1] = prior
    return langs, table


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: list[str] | None = None) -> DataFrame:
    """All columns of docs (or those named), with lang_pred and score (posterior probability, 0 to 1).

    Null texts, texts without a letter and an empty model give `und` and score 0. Columns named
    lang_pred or score are replaced. Rows are independent, so repeated rows and ids don't matter.
    """
    langs, table = model
    tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns if columns is None else columns
    told = docs.sparkSession.sparkContext.broadcast(table)  # of `languages` x buckets or `cells` numbers at most

    def run(batches):
        table = told.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if has_letter(t)] if langs else []
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            # sparse models have many languages: a text at a time
            for at in [[i] for i in at] if isinstance(table, Cells) else [at] if at else []:
                sums = table.sums(texts[at[0]])[None] if isinstance(table, Cells) else text_sums([texts[i] for i in at], table[:-1]) + table[-1]
                sums -= sums.max(axis=1, keepdims=True)
                p = np.exp(sums)
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                for i, k, s in zip(at, best, p.max(axis=1)):
                    pred[i], score[i] = langs[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])
        release()

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in columns), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out() -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
