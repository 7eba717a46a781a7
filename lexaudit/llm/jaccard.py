"""Operator 5: n-gram Jaccard join by parity sketches.

Documents of similar size share a band. In a band the hash space is dealt into more parts than the
largest symmetric difference a linked pair of the band can have; every shingle flips one bit of its
part, so the Hamming distance of two sketches never exceeds the symmetric difference, and at least
some parts of a linked pair are equal (pigeonhole). A document need not emit all parts:
in one order of parts that depends on their content alone, a pair's first equal part is among the
first D + 1 of either document, D being the largest difference it can have with a partner. Parts
with many rare shingles come first; which shingles count as frequent is read off a bounded sample
and affects the cost alone, not the result. Empty parts, which strangers share, come last: so many
parts leave hardly a document with fewer than D + 1 others.

Equal sets are one class from the start. Within a part's bucket every class is compared with the
bucket's smallest id only; what links is one component, and just the buckets that still hold
several components are joined pairwise, large ones in blocks. A dense sketch of every document,
carried along, rejects pairs by the same lower bound before their sets are read and compared. Sets
are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import by_bytes
from .common import Scratch, blocked, free, load, mix, narrowed, release, sampled, slices, tune, with_first
from .components import components
from .shingles import shingle_sets

#: Jaccard similarity of linked documents, in hundredths.
PERCENT = 80
#: Largest set size of each band.
BAND = [4 * 4**k for k in range(16)]
#: Bits of a part, least parts of a band, and 64-bit words of the dense sketch.
PART_BITS, LEAST_PARTS = 16, 33
DENSE = 8
#: Documents and shingles of the frequency sample; frequent: in so many sampled documents.
SAMPLE_DOCS, SAMPLE_SHINGLES, FREQUENT = 5000, 100_000, 4


def _band(n: int) -> int:
    return next(k for k, most in enumerate(BAND) if n <= most)


def signatures(h: np.ndarray, frequent: np.ndarray) -> list[np.ndarray]:
    """Bucket keys of a set: the first D + 1 parts of its own band, and of the band below if partners can be there."""
    n, out = len(h), []
    band = _band(n)
    rare = np.ones(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        rare = (frequent[at] != h).astype(np.int64)
    for k in (band, band - 1):
        if k < 0 or (k < band and 4 * n > 5 * BAND[k]):
            continue
        # D for J >= 0.8: (|A| + |B|) / 9, with |B| <= 1.25 |A| in the own band, |B| <= BAND[k] below it
        need = (n // 4 if k == band else (n + BAND[k]) // 9) + 1
        parts = np.uint64(max(3 * BAND[k] // 10 + 1, LEAST_PARTS))
        salt = np.uint64((k + 1) << 56)
        part = ((h >> np.uint64(32)) * parts) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        bits = mix(((part << np.uint64(PART_BITS)) | (h & np.uint64((1 << PART_BITS) - 1))) ^ salt)
        key = np.bitwise_xor.reduceat(bits, first) ^ mix(part[first] ^ salt ^ np.uint64(1 << 55))
        if len(first) > need:
            size = np.diff(np.append(first, n))
            key = key[np.lexsort((key, -size, -np.add.reduceat(rare, first)))[:need]]
        elif len(first) < need:
            empty = np.setdiff1d(np.arange(int(min(int(parts), need + len(first))), dtype=np.uint64), part[first])[: need - len(first)]
            key = np.concatenate([key, mix(empty ^ salt ^ np.uint64(1 << 55))])
        out.append(key)
    return out


def dense_sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes in DENSE * 64 bits."""
    flips = np.bincount((h & np.uint64(DENSE * 64 - 1)).astype(np.int64), minlength=DENSE * 64) & 1
    return np.packbits(flips.astype(np.uint8)).view("<i8")


def _frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that many sampled documents have, sorted; SAMPLE_SHINGLES at most."""
    total = docs.select("doc_id").count()
    rows = docs.select("doc_id", "text")
    if total > SAMPLE_DOCS:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_DOCS / total))

    def run(batches):
        for batch in batches:
            for h in shingle_sets(batch.column("text").to_pylist()):
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    top = rows.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(SAMPLE_SHINGLES)
    return np.sort(np.array([r.h for r in top.select("h").collect()], np.int64).view(np.uint64))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (hash of the set), dense sketch and bucket keys of each row."""
    told = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def run(batches):
        frequent = told.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").cast(pa.int64())
            for a, b in by_bytes(texts):
                sets = shingle_sets(texts[a:b])
                s1 = [int(np.bitwise_xor.reduce(h).view(np.int64)) if len(h) else 0 for h in sets]
                s2 = [int(mix(h ^ np.uint64(77)).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0 for h in sets]
                keys = [signatures(h, frequent) if len(h) else [] for h in sets]
                flat = np.concatenate([k for own in keys for k in own] or [np.zeros(0, np.uint64)]).view(np.int64)
                cuts = np.concatenate([[0], np.cumsum([sum(map(len, own)) for own in keys])])
                sketch = np.concatenate([dense_sketch(h) for h in sets])
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array([len(h) for h in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(sketch) + 1, DENSE), pa.int32()), pa.array(sketch)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))],
                    ["doc_id", "n", "s1", "s2", "sketch", "keys"],
                )
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch array<long>, keys array<long>")


def _near_sketch(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and dense sketches allow a link."""
    side = lambda x: info.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    size = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT) & (apart * 9 <= F.col("n_a") + F.col("n_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(size).select("a", "b")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and sorted shingle hashes of the documents in `ids`, a kept table."""

    def run(batches):
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("doc_id").cast(pa.int64())
            for a, b in by_bytes(texts):
                yield pa.RecordBatch.from_arrays([own[a:b], pa.array([h.tobytes() for h in shingle_sets(texts[a:b])], pa.binary())], ["doc_id", "h"])

    return narrowed(docs.select("doc_id", "text"), ids).select("doc_id", "text").mapInArrow(run, "doc_id long, h binary")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets are similar enough, compared exactly."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, ["h_a", "h_b"])):
            ok = []
            for x, y in zip(batch.column("h_a").to_pylist(), batch.column("h_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("h").alias(f"h_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_shingles, component_id.

    Null texts and texts without words have the empty set and are linked with nothing. Rows that
    repeat an id are one document that has each of their texts. A null id has no component unless
    its class holds an id. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "jaccard")
    told = scratch.keep(describe(docs), "sets")
    full = told.where("n > 0")
    classes = scratch.keep(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    copies = lambda f: f.join(classes.where("copies > 1").drop("copies"), ["s1", "s2", "n"]).where("doc_id <> rep").select("s1", "s2", "n", "doc_id")
    single = full.where("doc_id is not null").join(copies(full), ["s1", "s2", "n", "doc_id"], "left_anti")
    info = scratch.keep(single.select("doc_id", "n", "sketch", "keys"), "info")
    told = scratch.keep(told.select("doc_id", "n", "s1", "s2"), "ids")
    full = told.where("n > 0")
    scratch.drop("sets")

    rows = lambda df: df.select(F.explode("keys").alias("key"), "doc_id", "n")
    shared = scratch.keep(with_first(rows(info), rows(sampled(info, F.col("doc_id"))), ["doc_id", "n"], scratch, "keys"), "shared")
    free(spark)
    n = shared.count()
    fits = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * PERCENT
    stars = shared.where((F.col("p_doc_id") != F.col("doc_id")) & fits).select(F.col("p_doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = scratch.keep(_near_sketch(stars, info), "stars")
    ids = lambda p: p.select(F.col("a").alias("doc_id")).unionByName(p.select(F.col("b").alias("doc_id"))).distinct()
    n_stars = stars.count()
    sets = scratch.keep(_sets(docs, scratch.keep(ids(stars), "star_ids", n_stars)), "star_sets")
    links = scratch.keep(_linked(stars, sets), "star_links", n_stars, 1000)
    # an id that is repeated links the classes of its texts
    repeated = full.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = copies(full).join(repeated, "doc_id", "left_semi").join(classes, ["s1", "s2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = links.unionByName(scratch.keep(own, "own"))
    free(spark)
    edges = lambda p: p.select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = scratch.keep(components(edges(links), scratch, "star"), "star_components", 2 * links.count())

    # buckets in which a class is apart from the pivot's component, pairwise
    of = lambda c, x: found.select(F.col("node").alias(c), F.col("component").alias(x))
    rest = shared.join(of("doc_id", "c"), "doc_id", "left").join(of("p_doc_id", "p"), "p_doc_id", "left").select("key", "doc_id", "n", F.coalesce("c", "doc_id").alias("c"), F.coalesce("p", "p_doc_id").alias("p"))
    apart = scratch.keep(rest.where("c <> p").select("key").distinct(), "apart", n)
    rest = scratch.keep(rest.join(apart, "key", "left_semi").drop("p"), "rest", n)
    # the sketches decide within the join, so it puts out no more than pairs that may well link
    bits = [F.get("sketch", k).alias(f"k{k}") for k in range(DENSE)]
    known = blocked(rest, "key", F.col("doc_id"), scratch, "rest").join(info.select("doc_id", *bits), "doc_id")
    x, y = (known.select("key", "cell", *(F.col(c).alias(f"{c}_{i}") for c in ("side", "doc_id", "n", "c", *(f"k{k}" for k in range(DENSE))))) for i in "ab")
    once = ((F.col("side_a") == 2) & (F.col("doc_id_a") < F.col("doc_id_b"))) | ((F.col("side_a") == 0) & (F.col("side_b") == 1))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    far = sum((F.bit_count(F.col(f"k{k}_a").bitwiseXOR(F.col(f"k{k}_b"))) for k in range(DENSE)), F.lit(0))
    pairs = x.join(y, ["key", "cell"]).where(once & (F.col("c_a") != F.col("c_b")) & near & (far * 9 <= F.col("n_a") + F.col("n_b")))
    pairs = pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    pairs = scratch.keep(pairs, "pairs")
    scratch.drop("shared", "rest", "apart")
    if n_pairs := pairs.count():
        missing = scratch.keep(ids(pairs).join(sets.select("doc_id"), "doc_id", "left_anti"), "pair_ids", 2 * n_pairs)
        sets = sets.unionByName(scratch.keep(_sets(docs, missing), "pair_sets"))
        more = scratch.keep(_linked(pairs, sets), "pair_links", n_pairs, 1000)
        if n_more := more.count():
            found = scratch.keep(components(edges(links.unionByName(more)), scratch, "all"), "components", 2 * (links.count() + n_more))
    free(spark)

    # back to all rows: class, then component; ids repeated with other texts link through the id
    rep = classes.select("s1", "s2", "n", "rep")
    out = told.select("doc_id", "n", "s1", "s2").join(rep, ["s1", "s2", "n"], "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    out = scratch.keep(out, "result")
    scratch.drop(*(x for x in scratch.labels() if x != "result"))
    return out


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


ORACLE = """
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (
    select distinct doc_id, array_to_string(w[p + 1 : p + 5], ' ') as g from (select doc_id, w, unnest(range(len(w) - 4)) as p from d where len(w) >= 5)
    union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select u, v from l join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 80 * (x.n + y.n - k)),
r as (select u as node, u as c from e union select r.node, e.v from r join e on e.u = r.c)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, cast(coalesce(m.c, d.doc_id) as bigint) as component_id
from d left join n on n.doc_id = d.doc_id left join (select node, min(c) as c from r group by node) m on m.node = d.doc_id
"""
