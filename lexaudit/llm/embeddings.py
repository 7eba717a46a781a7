"""Operator 7: embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised, so a cosine of c is a Euclidean distance of sqrt(2 - 2c). Each of `tables`
tables hashes them by `width` quantised random projections; vectors that share a bucket of some
table are compared by their exact cosine in double precision. The number of projections follows the
number of vectors, so that a bucket has room for STRANGERS: comparing them is a matrix product,
while every further table shuffles all vectors once more. The number of tables follows from it and
the recall wanted at the threshold itself.

Equal vectors are one class, with its number of copies. A bucket above BLOCK members is dealt into
blocks and its pairs into cells of two blocks, so no task gets a bucket whole. A pair counts in the
first table in which it meets, which the vectors' buckets in the tables before tell; so no pairs are
shuffled or made distinct. A cell emits for each vector the number of its new links and one link to
the smallest id it is connected with.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, load, mix, release, tune
from .components import components

COSINE = 0.9
#: Width of a quantisation step, for unit vectors.
STEP = 2.0
#: Recall wanted for pairs right at the threshold; closer pairs are found more surely.
RECALL = 0.99
#: Unrelated vectors that a bucket may have, and members of a bucket that are compared in one piece.
STRANGERS, BLOCK = 512, 1024
SEED = 7


def _meets(distance: float, step: float = STEP) -> float:
    """Probability that one quantised projection is equal for two vectors so far apart."""
    r = step / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors."""
    near, far = _meets(math.sqrt(2 - 2 * cosine)), _meets(math.sqrt(2))
    width = max(2, math.ceil(math.log(max(n / STRANGERS, 2)) / -math.log(far)))
    return width, math.ceil(math.log(1 - recall) / math.log(1 - near**width))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, whatever their scale."""
    x = v.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(vectors: DataFrame, width: int, tables: int) -> DataFrame:
    """id, copies, v (the vector, packed) and sig (32-bit bucket of each table, packed)."""
    kind = vectors.schema["embedding"].dataType.elementType
    packed = np.float32 if isinstance(kind, T.FloatType) else np.float64

    def run(batches):
        planes: dict[int, tuple] = {}
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            v, sig = [b""] * len(rows), [b""] * len(rows)
            for dim in {len(r) for r in rows}:
                if dim not in planes:
                    rng = np.random.default_rng([SEED, dim])
                    planes[dim] = rng.normal(size=(dim, tables * width)), rng.uniform(0, STEP, tables * width), mix(rng.integers(1, 1 << 62, (1, tables, width)).astype(np.uint64)) | np.uint64(1)
                a, b, c = planes[dim]
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                x = np.array([rows[i] for i in at], packed)
                h = np.floor((_unit(x) @ a + b) / STEP).astype(np.int64).astype(np.uint64).reshape(len(at), tables, width)
                h = mix((h * c).sum(axis=2, dtype=np.uint64) + np.uint64(dim)) >> np.uint64(32)
                for k, i in enumerate(at):
                    v[i], sig[i] = x[k].tobytes(), h[k].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), pa.array(v, pa.binary()), pa.array(sig, pa.binary())], ["id", "copies", "v", "sig"])
        release()

    return vectors.select("id", "copies", "embedding").mapInArrow(run, "id long, copies long, v binary, sig binary")


def _bucket(table: Column, sig: Column) -> Column:
    """Table and 32-bit bucket in one number."""
    return F.shiftleft(table.cast("long"), 32).bitwiseOR(F.conv(F.hex(F.substring(sig, table * 4 + 1, 4)), 16, 10).cast("long"))


def _links(ids, copies, table, side, whole, x, sig, starts, sizes, cosine):
    """(id, new links, smallest id connected with) of the vectors of cells: runs of rows, each of one table."""
    n = len(ids)
    count, root = np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    us, vs = [], []
    for a, s in zip(starts.tolist(), sizes.tolist()):
        b = a + s
        near = x[a:b] @ x[a:b].T >= cosine
        if not whole[a]:
            near &= side[a:b, None] != side[None, a:b]
        i, j = np.nonzero(np.triu(near, 1))
        if not len(i):
            continue
        i, j = i + a, j + a
        ok = ids[i] != ids[j]
        i, j = i[ok], j[ok]
        us.append(i)
        vs.append(j)
        # new unless they met in a table before
        new = ~(sig[i, : table[a]] == sig[j, : table[a]]).any(axis=1)
        np.add.at(count, i[new], copies[j[new]])
        np.add.at(count, j[new], copies[i[new]])
    if not us or not sum(map(len, us)):
        return None
    i, j = rank[np.concatenate(us)], rank[np.concatenate(vs)]
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    linked = np.unique(np.concatenate([i, j]))
    at = order[linked]
    return ids[at], count[at], ids[order[root[linked]]]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without an
    id, link with nothing; vectors of different length don't link. Rows that repeat an id are not
    links of each other; they, and copies of their vectors, share the links of all of them. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "embeddings")
    kind = vectors.schema["embedding"].dataType
    packed = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # others are compared as doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if packed else "array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = rows.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    valid = valid.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast("float" if packed else "double")).otherwise(x)))  # one zero
    classes = scratch.keep(valid.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies")), "classes")
    n = classes.count()
    width, tables = plan(n, cosine, recall)
    told = scratch.keep(_hashed(classes, width, tables), "hashed")
    every = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table")
    members = told.select("id", "copies", "v", "sig", every).withColumn("key", _bucket(F.col("table"), F.col("sig")))
    large = told.select("sig", every).select(_bucket(F.col("table"), F.col("sig")).alias("key")).groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    members = members.join(scratch.keep(large, "large"), "key", "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    # a block's members meet those of every block, its own included, once; negative cells: all pairs
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.when(x == F.col("own"), -2 - x.cast("long")).otherwise(F.least(x, F.col("own")).cast("long") * F.col("blocks") + F.greatest(x, F.col("own"))))
    )
    # of the buckets, those of the tables before are enough
    members = members.select("id", "copies", "v", F.substring("sig", F.lit(1), F.col("table") * 4).alias("sig"), "table", "key", "own", F.explode(cells).alias("cell"))

    def run(batches):
        held: list[list] = []

        def cut(batch):
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            return [get("key"), get("cell"), get("id"), get("copies"), get("table"), get("own"), batch.column("v").to_pylist(), batch.column("sig").to_pylist()]

        def work(cols):
            key, cell, ids, copies, table, own, v, sig = cols
            if not len(key):
                return None
            change = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(key)))
            got = [[], [], []]
            # cells of one table and one length of vectors at a time
            groups: dict[tuple, list] = {}
            for a, s in zip(starts.tolist(), sizes.tolist()):
                if s > 1:
                    by: dict[int, list] = {}
                    for i in range(a, a + s):
                        by.setdefault(len(v[i]), []).append(i)
                    for size, at in by.items():
                        if len(at) > 1:
                            groups.setdefault((int(table[a]), size), []).append(at)
            for (t, size), runs in groups.items():
                at = np.array([i for r in runs for i in r])
                s = np.array([len(r) for r in runs])
                x = _unit(np.frombuffer(b"".join([v[i] for i in at]), np.float32 if packed else np.float64).reshape(len(at), -1))
                y = np.frombuffer(b"".join([sig[i] for i in at]), "<u4").reshape(len(at), t)
                found = _links(ids[at], copies[at], table[at], own[at], cell[at] < 0, x, y, np.cumsum(s) - s, s, cosine)
                if found:
                    for a, b in zip(got, found):
                        a.append(b)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in got], ["id", "links", "root"]) if got[0] else None

        def join(parts):
            return [sum((p[k] for p in parts), []) if isinstance(parts[0][k], list) else np.concatenate([p[k] for p in parts]) for k in range(8)]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(cut(batch))
            key, cell = held[-1][0], held[-1][1]
            if key[-1] == held[0][0][0] and cell[-1] == held[0][1][0]:
                continue  # a cell that goes on; cells are bounded
            cols = join(held)
            key, cell = cols[0], cols[1]
            last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1] + 1
            held = [[c[last:] for c in cols]]
            if out := work([c[:last] for c in cols]):
                yield out
        if held:
            if out := work(join(held)):
                yield out
        release()

    dealt = members.repartition("key", "cell").sortWithinPartitions("key", "cell")
    links = scratch.keep(dealt.mapInArrow(run, "id long, links long, root long"), "links")
    n_links = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")), scratch)
    known = classes.join(n_links, "id", "left").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    known = scratch.keep(known.select("embedding", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "known")
    ok = valid.select("vec_id", "embedding").join(known, "embedding").select("vec_id", "n_links", "component_id")
    odd = rows.where(~F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)) | F.col("vec_id").isNull())
    out = ok.unionByName(odd.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    out = scratch.keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop(*(x for x in scratch.labels() if x != "result"))
    return out


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))
