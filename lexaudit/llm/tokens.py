"""Operator 2: token ids in a binary format compressed by Re-Pair.

Documents are dealt out by ranges of doc_id and encoded in ascending order. Each task writes shards
of up to SHARD_TOKENS ids. Within a shard, rounds of Re-Pair replace frequent id pairs by
nonterminals: a round counts the adjacent pairs inside documents exactly, takes the most frequent
ones of which none ends with what another begins with (so that occurrences never overlap), and
replaces every occurrence. Rounds end when no pair occurs LEAST times. A shard is one row of a
Parquet table with binary columns:

    rules     two little-endian symbols for each nonterminal, numbered from `base` on
    lengths   little-endian uint32, the ids that each nonterminal expands to
    symbols   the documents' symbols one after the other (uint16 while they fit, else uint32)
    alphabet  little-endian uint32, the ids that occur; in the file, symbols and rules count them
              from 0 and nonterminals after them, `unpack` gives ids and numbers from `base` on
    doc_ids, doc_symbols, doc_tokens   int64 for each document: id, its symbols, its ids

The expansion lengths find any position of any document without decoding what is before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import END_ID, by_bytes, default_path, encoder
from .common import Scratch, load, ragged, tune

SHARD_TOKENS = 2_000_000
RULES_A_ROUND, LEAST = 10_000, 8

SHARD = "shard int, part long, base long, wide boolean, rules binary, lengths binary, symbols binary, alphabet binary, doc_ids binary, doc_null binary, doc_symbols binary, doc_tokens binary"


def compress(ids: np.ndarray, doc_tokens: np.ndarray, base: int, most: int = RULES_A_ROUND, least: int = LEAST):
    """(symbols, symbols of each document, rules, expansion length of each rule).

    Documents have no empty sequence, as each ends with an end id. Replacing a pair makes new pairs
    at its place and before it only, and those of older symbols get rarer. So a pair that is not
    frequent never will be: a round looks at the places of frequent pairs and those next to what
    the last round replaced. A pair is no more frequent than the hash slot it falls into, so only
    pairs of full slots are sorted and counted.
    """
    n, ends = len(ids), np.cumsum(doc_tokens)
    seq, alive, mark = ids.astype(np.uint32), np.ones(n, bool), np.zeros(n, bool)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # places of the symbols beside
    after[ends - 1] = -1  # no pair across documents
    before[ends - doc_tokens] = -1
    rules, size, span = [np.zeros((0, 2), np.uint32)], base, np.ones(base, np.uint32)
    at = np.flatnonzero(after >= 0)
    while len(at):
        beside = after[at]
        left, right = seq[at], seq[beside]
        use = None
        same = np.flatnonzero(left == right)
        if len(same):  # a symbol with itself: every other place of a run, so that occurrences don't overlap
            run = np.flatnonzero(np.concatenate([[True], beside[same[:-1]] != at[same[1:]]]))
            nth = np.arange(len(same)) - np.repeat(run, np.diff(run, append=len(same)))
            use = np.ones(len(at), bool)
            use[same[nth % 2 == 1]] = False
        code = left.astype(np.uint64)
        code <<= np.uint64(32)
        code |= right
        del beside, left, right
        bits = len(at).bit_length()
        slot_of = lambda c: ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
        slot = slot_of(code)
        full = (np.bincount(slot if use is None else slot[use], minlength=1 << bits) >= least)[slot]  # flags are small to look up
        mark[:] = False
        mark[at] = full
        if use is not None:
            full &= use
        full = np.flatnonzero(full)
        at, code, slot = at[full], code[full], slot[full]
        ordered = np.sort(code)
        first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
        count = np.diff(first, append=len(ordered))
        some = np.flatnonzero(count >= least)
        if not len(some):
            break
        some = some[np.argsort(-count[some], kind="stable")][: 4 * most]
        found = ordered[first[some]]
        both = np.stack([found >> np.uint64(32), found & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        firsts, seconds, taken = set(), set(), {}
        for k, ((a, b), own) in enumerate(zip(both.tolist(), slot_of(found).tolist())):
            if a not in seconds and b not in firsts and own not in taken:  # a slot has one rule a round
                firsts.add(a)
                seconds.add(b)
                taken[own] = k
                if len(taken) == most:
                    break
        slots, taken = np.array(list(taken)), np.array(list(taken.values()))
        rule = np.full(1 << bits, -1, np.int32)
        rule[slots] = np.arange(len(taken))
        hit = rule[slot]
        own = np.flatnonzero(hit >= 0)
        own = own[code[own] == found[taken][hit[own]]]
        where, hit = at[own], hit[own]
        pairs = both[taken]
        rules.append(pairs)
        span = np.concatenate([span, span[pairs[:, 0]] + span[pairs[:, 1]]])
        gone = after[where]
        then = after[gone]
        seq[where] = (size + hit).astype(np.uint32)
        alive[gone] = False
        after[where] = then
        before[then[then >= 0]] = where[then >= 0]
        size += len(taken)
        mark[where] = True
        last = before[where]
        mark[last[last >= 0]] = True
        mark[gone] = False
        at = np.flatnonzero(mark)
        at = at[after[at] >= 0]
    return seq[alive], np.add.reduceat(alive, ends - doc_tokens, dtype=np.int64) if n else np.zeros(0, np.int64), np.concatenate(rules), span[base:]


def narrow(symbols: np.ndarray, rules: np.ndarray, base: int) -> dict:
    """wide, rules, symbols and alphabet of a shard's row: the ids that occur are numbered anew, then come the nonterminals."""
    used = np.unique(np.concatenate([symbols[symbols < base], rules[rules < base]]))
    number = np.zeros(base + len(rules), np.uint32)
    number[used], number[base:] = np.arange(len(used)), np.arange(len(used), len(used) + len(rules))
    wide = len(used) + len(rules) > 1 << 16
    kind = "<u4" if wide else "<u2"
    return {"wide": wide, "rules": number[rules].astype(kind).tobytes(), "symbols": number[symbols].astype(kind).tobytes(), "alphabet": used.astype("<u4").tobytes()}


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids of a run of symbols: the rules are expanded once, in their order, then gathered.

    Rules up to the first that needs one of them are expanded together."""
    if not len(rules):
        return symbols.astype(np.uint32)
    newest = np.maximum.accumulate(rules.max(axis=1).astype(np.int64) - base)
    waves = [0]
    while waves[-1] < len(rules):
        waves.append(int(np.searchsorted(newest, waves[-1])))
    if lengths is None:
        lens = np.zeros(len(rules), np.int64)
        for k, stop in zip(waves[:-1], waves[1:]):
            own = rules[k:stop].astype(np.int64) - base
            lens[k:stop] = np.where(own >= 0, lens[own * (own >= 0)], 1).sum(axis=1)
    else:
        lens = lengths.astype(np.int64)
    stops = np.cumsum(lens)
    flat = np.empty(int(stops[-1]), np.uint32)

    def gathered(symbols: np.ndarray) -> np.ndarray:
        which = symbols.astype(np.int64) - base
        is_id = which < 0
        which[is_id] = 0
        n = np.where(is_id, 1, lens[which])
        out = flat[ragged(np.where(is_id, 0, stops[which] - lens[which]), n)]
        out[(np.cumsum(n) - n)[is_id]] = symbols[is_id]
        return out

    for k, stop in zip(waves[:-1], waves[1:]):
        flat[stops[k] - lens[k] : stops[stop - 1]] = gathered(rules[k:stop].ravel())
    return gathered(symbols)


def unpack(row: dict) -> dict:
    """Arrays of a shard's row."""
    kind = "<u4" if row["wide"] else "<u2"
    read = lambda c, t: np.frombuffer(row[c], t)
    lengths = read("lengths", "<u4")
    number = np.concatenate([read("alphabet", "<u4"), row["base"] + np.arange(len(lengths), dtype=np.uint32)]).astype(np.uint32)
    return {"base": row["base"], "rules": number[read("rules", kind)].reshape(-1, 2), "lengths": lengths, "symbols": number[read("symbols", kind)]} | {c: read(c, "<i8") for c in ("doc_ids", "doc_symbols", "doc_tokens")} | {"doc_null": read("doc_null", np.uint8).astype(bool)}


def read_span(shard: dict, doc: int, start: int, length: int) -> np.ndarray:
    """Ids start .. start + length - 1 of the shard's doc-th document, expanding just the symbols that cover them."""
    first = int(shard["doc_symbols"][:doc].sum())
    own = shard["symbols"][first : first + int(shard["doc_symbols"][doc])].astype(np.int64)
    spans = np.ones(len(own), np.int64)
    is_rule = own >= shard["base"]
    spans[is_rule] = shard["lengths"][own[is_rule] - shard["base"]]
    ends = np.cumsum(spans)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + length, side="left") + 1
    got = expand(own[a:b], shard["rules"], shard["base"], shard["lengths"])
    skip = start - (int(ends[a - 1]) if a else 0)
    return got[skip : skip + length]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write (doc_id, text) as shards at `path`, in ascending doc_id order over (shard, part).

    Null and empty texts are the end id alone; rows that repeat an id are written each, in the order
    of their texts; ids that are null come first; an empty table writes no shard. Other columns are
    ignored.
    """
    tune(docs.sparkSession)
    file = tokenizer or default_path()

    def run(batches):
        enc, task, part = encoder(file), TaskContext.get().partitionId(), 0
        base = enc.vocabulary
        ids, counts, names, held = [], [], [], 0

        def shard():
            nonlocal part
            tokens = np.concatenate(counts)
            flat = np.concatenate(ids)
            seq, n_symbols, rules, lengths = compress(flat, tokens, base)
            own = [x for some in names for x in some]
            made = narrow(seq, rules, base)
            row = [task, part, base, made["wide"], made["rules"], lengths.astype("<u4").tobytes(), made["symbols"], made["alphabet"], np.array([x or 0 for x in own], "<i8").tobytes(), np.array([x is None for x in own], np.uint8).tobytes(), n_symbols.astype("<i8").tobytes(), tokens.astype("<i8").tobytes()]
            part += 1
            for x in (ids, counts, names):
                x.clear()
            types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * 8
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["shard", "part", "base", "wide", "rules", "lengths", "symbols", "alphabet", "doc_ids", "doc_null", "doc_symbols", "doc_tokens"])

        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("doc_id").cast(pa.int64()).to_pylist()
            for a, b in by_bytes(texts):
                flat, n = enc.encode(texts[a:b])
                # the end id after each document
                full = np.full(len(flat) + len(n), end_id, np.uint32)
                stops = np.cumsum(n + 1)
                full[ragged(stops - n - 1, n)] = flat
                ids.append(full)
                counts.append(n + 1)
                names.append(own[a:b])
                held += len(full)
                if held >= shard_tokens:
                    yield shard()
                    held = 0
        if counts:
            yield shard()
        enc.rest_now()

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SHARD).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, part, place (in the shard), n_tokens, ids_crc32 and ids_sum of every document, decoded from the shards."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = unpack(row)
                ids = expand(s["symbols"], s["rules"], s["base"]).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(s["doc_tokens"])])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["doc_ids"], mask=s["doc_null"]), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["part"]] * n, pa.int64()), pa.array(cuts[:-1], pa.int64()), pa.array(s["doc_tokens"]), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "part", "place", "n_tokens", "ids_crc32"],
                )

    tune(spark)  # rows are whole shards: batches are bounded by their bytes
    return spark.read.schema(SHARD).parquet(path).mapInArrow(run, "doc_id long, shard int, part long, place long, n_tokens long, ids_crc32 long")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    write_tokens(load(spark, sf_dir, "documents"), scratch.path("ids"), shard_tokens=SHARD_TOKENS)
    read = scratch.keep(read_tokens(spark, scratch.path("ids")), "read")
    # ids before each shard: one row a task after the first sum, summed on over the tasks
    by_part = read.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n"))
    by_shard = by_part.groupBy("shard").agg(F.sum("n").alias("n"))
    before = by_shard.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shards"))
    parts = by_part.select("shard", "part", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("parts"))
    base = parts.join(before, "shard").select("shard", "part", (F.col("shards") + F.col("parts")).alias("base"))
    return read.join(base, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
