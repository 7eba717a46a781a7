"""Operator 9: best-fit packing by linear grouping.

Texts become token ids; only those longer than a sequence are cut, into whole sequences and one
shorter first piece. Whole pieces fill a sequence each. For the shorter pieces nothing but their
histogram by length reaches the driver (at most capacity - 1 rows at any input size). There

1. large lengths are dealt in descending order into groups of equal cardinality and rounded up to
   each group's largest length,
2. the few rounded sizes are packed by configurations, optimised by column generation (a revised
   simplex with a knapsack as pricing), and what rounding down leaves over by first fit,
3. the actual lengths take the places of the rounded ones, run by run, and
4. small pieces fill the gaps by best fit, longest first.

The layout is a table of runs (bounded by lengths and configurations, not by pieces) that maps the
r-th piece of a length to its sequence and offset. Each piece's rank among those of its length is a
task's running number plus a prefix sum over (task, length), so no group of pieces meets in a task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import END_ID, by_bytes, default_path, encoder
from .common import Scratch, load, tune

CAPACITY = 1024
#: Pieces of at least this share of a sequence are large.
LARGE = 1 / 4
GROUPS = 96


# ---------------------------------------------------------------- the plan, on the driver


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of whole numbers of each size within the capacity, and those numbers."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], take[c] = best[c - 1], -2
        fit = np.flatnonzero(sizes <= c)
        if len(fit):
            got = best[c - sizes[fit]] + values[fit]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], take[c] = got[k], fit[k]
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0 and take[c] != -1:
        if take[c] == -2:
            c -= 1
        else:
            out[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """(numbers of each size, sequences) that cover the demand exactly; near the linear bound."""
    m = len(sizes)
    if not m:
        return []
    base = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(base)
    for _ in range(rounds):
        duals = np.linalg.solve(base.T, np.ones(m))
        value, column = _knapsack(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(base, column.astype(float))
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * step
        x[out], base[:, out] = ratio[out], column
    left, plan = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x):
        column = np.round(base[:, k]).astype(np.int64)
        use = column > 0
        times = min(int(np.floor(x[k] + 1e-9)), int((left[use] // column[use]).min()) if use.any() else 0)
        if times > 0:
            plan.append((column, times))
            left -= column * times
    while left.any():  # what is left over: first fit, longest first
        column, room = np.zeros(m, np.int64), capacity
        for k in np.argsort(-sizes):
            column[k] = min(left[k], room // sizes[k])
            room -= column[k] * sizes[k]
        use = column > 0
        times = int((left[use] // column[use]).min())
        plan.append((column, times))
        left -= column * times
    return plan


def plan_layout(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, places in a sequence, first sequence, sequences, offset) and the number of sequences.

    The piece of rank r in its length lies in the row with first rank f <= r, in sequence
    first + (r - f) // places, at offset + ((r - f) % places) * length.
    """
    big = sorted((n for n in counts if n >= large * capacity and counts[n]), reverse=True)
    total = sum(counts[n] for n in big)
    each = -(-total // groups) if total else 1
    runs: list[list[list[int]]] = []  # of each group: [length, count], descending
    room = 0
    for n in big:
        left = counts[n]
        while left:
            if room == 0:
                runs.append([])
                room = each
            take = min(left, room)
            runs[-1].append([n, take])
            left, room = left - take, room - take
    # groups rounded up to the same length are one size
    merged: list[list[list[int]]] = []
    for g in runs:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    sizes = np.array([g[0][0] for g in merged], np.int64)
    demand = np.array([sum(c for _, c in g) for g in merged], np.int64)
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []  # ((length, places), ...), sequences
    for column, times in configurations(sizes, demand, capacity):
        slots = [k for k in np.flatnonzero(column) for _ in range(column[k])]
        # each slot takes the next `times` pieces of its group's stream
        streams = []
        for k in slots:
            got, need = [], times
            while need:
                n, c = merged[k][0]
                take = min(c, need)
                got.append([n, take])
                need -= take
                if take == c:
                    merged[k].pop(0)
                else:
                    merged[k][0][1] -= take
            streams.append(got)
        while streams and streams[0]:
            step = min(s[0][1] for s in streams)
            bins.append((tuple((s[0][0], 1) for s in streams), step))
            for s in streams:
                s[0][1] -= step
                if not s[0][1]:
                    s.pop(0)
    by_room: dict[int, list] = defaultdict(list)
    for content, times in bins:
        by_room[capacity - sum(n * c for n, c in content)].append((content, times))
    for n in sorted((n for n in counts if n < large * capacity and counts[n]), reverse=True):
        left = counts[n]
        for r in sorted(r for r in by_room if r >= n):
            if not left:
                break
            fits, kept = r // n, []
            for content, times in by_room.pop(r):
                full = min(times, left // fits)
                if full:
                    by_room[r - fits * n].append(((*content, (n, fits)), full))
                    left -= full * fits
                if times > full and left:  # one sequence takes the rest
                    by_room[r - left * n].append(((*content, (n, left)), 1))
                    full, left = full + 1, 0
                if times > full:
                    kept.append((content, times - full))
            if kept:
                by_room[r] = by_room.get(r, []) + kept
        if left:
            fits = capacity // n
            if left // fits:
                by_room[capacity - fits * n].append((((n, fits),), left // fits))
            if left % fits:
                by_room[capacity - (left % fits) * n].append((((n, left % fits),), 1))
    rows, rank, first = [], defaultdict(int), 0
    for group in by_room.values():
        for content, times in group:
            offset = 0
            for n, places in content:
                rows.append((n, rank[n], places, first, times, offset))
                rank[n] += places * times
                offset += n * places
            first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6), first


# ---------------------------------------------------------------- pieces


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per document: doc_id, n_tokens, rem (length of the shorter first piece, 0 if none),
    task and rank (its number among the task's pieces of that length), full (number of the task's
    first whole piece of it), crcs (of its pieces)."""
    path, schema = tokenizer or default_path(), "doc_id long, n_tokens long, rem int, task int, rank long, full long, crcs array<long>"

    def run(batches):
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen, full = np.zeros(capacity + 1, np.int64), 0
        for batch in batches:
            ids_, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            out = {"n": [], "rem": [], "rank": [], "full": [], "crcs": []}
            for a, b in by_bytes(texts):
                ids, counts = enc.encode(texts[a:b])
                at = 0
                for n in counts.tolist():
                    own = np.empty(n + 1, "<u4")
                    own[:n], own[n] = ids[at : at + n], end_id
                    at += n
                    rem = (n + 1) % capacity
                    cuts = ([0] if rem else []) + list(range(rem, n + 1, capacity))
                    out["n"].append(n + 1)
                    out["rem"].append(rem)
                    out["rank"].append(int(seen[rem]))
                    out["full"].append(full)
                    out["crcs"].append([zlib.crc32(own[c : (rem if c == 0 and rem else c + capacity)]) for c in cuts])
                    seen[rem] += 1
                    full += (n + 1) // capacity
            yield pa.RecordBatch.from_arrays(
                [ids_.cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["rem"], pa.int32()), pa.array([task] * len(texts), pa.int32()), pa.array(out["rank"], pa.int64()), pa.array(out["full"], pa.int64()), pa.array(out["crcs"], pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "rem", "task", "rank", "full", "crcs"],
            )
        enc.rest_now()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """Pack every document of (doc_id, text) into sequences of at most `capacity` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are the end id alone; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored. Sequences of whole pieces have negative numbers.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "packing")
    doc = scratch.keep(pieces(docs, tokenizer, capacity, end_id), "documents")
    short = doc.where("rem > 0").groupBy("rem", "task").agg(F.count("*").alias("n"))
    short = scratch.keep(short.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("rem").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "ranks")
    counts = {r.rem: r.n for r in short.groupBy("rem").agg(F.sum("n").alias("n")).collect()}  # capacity - 1 rows at most
    layout, n_sequences = plan_layout(counts, capacity, groups=groups)
    key = layout[:, 0] * (1 << 44) + layout[:, 1] if len(layout) else np.zeros(0, np.int64)
    told = spark.sparkContext.broadcast((layout, key))
    schema = "doc_id long, rem int, n_tokens long, task int, full long, crcs array<long>, sequence long, at long"

    def place(batches):
        layout, key = told.value
        for batch in batches:
            rem, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rem", "rank"))
            k = np.maximum(np.searchsorted(key, rem * (1 << 44) + rank, side="right") - 1, 0)
            row = layout[k] if len(layout) else np.zeros((len(rem), 6), np.int64)
            d, places = rank - row[:, 1], np.maximum(row[:, 2], 1)
            sequence, at = row[:, 3] + d // places, row[:, 5] + (d % places) * rem
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "rem", "n_tokens", "task", "full", "crcs")] + [pa.array(sequence), pa.array(at)], names=["doc_id", "rem", "n_tokens", "task", "full", "crcs", "sequence", "at"])

    ranked = doc.join(short.select("rem", "task", "base"), ["rem", "task"], "left").withColumn("rank", F.col("rank") + F.coalesce("base", F.lit(0)))
    placed = ranked.select("doc_id", "rem", "n_tokens", "task", "full", "crcs", "rank").mapInArrow(place, schema)
    part = placed.select("doc_id", "rem", "task", "full", "sequence", "at", F.posexplode("crcs").alias("piece", "ids_crc32"))
    lead = (F.col("rem") > 0).cast("int")
    first = (F.col("piece") == 0) & (F.col("rem") > 0)
    whole = F.col("piece") - lead  # number among the document's whole pieces
    return part.select(
        "doc_id",
        "piece",
        F.when(first, F.lit(0)).otherwise(F.col("rem") + whole * capacity).cast("long").alias("start"),
        F.when(first, F.col("rem")).otherwise(F.lit(capacity)).cast("long").alias("length"),
        "ids_crc32",
        F.when(first, F.col("sequence")).otherwise(-1 - (F.col("task").cast("long") * (1 << 36) + F.col("full") + whole)).alias("sequence_id"),
        F.when(first, F.col("at")).otherwise(F.lit(0).cast("long")).alias("offset"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
