"""The token layer: segments, tokens with offsets and flags, vocabulary and two-word phrases.

Everything is per document. Tokens are found in one scan of each text, where it is; what is shuffled
are counts of words.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Stands in a copy of the text where a sentence boundary, with its decoration, ends.
MARK = "\x01"
BOUNDARY = rf"([.!?:]|\n[{T.WS}]*\n)[{T.DECORATION}{T.WS}]*"


def plain(docs: DataFrame) -> DataFrame:
    """(doc_id, text), null texts as empty ones, where they are."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text), null texts as empty ones, dealt out by doc_id."""
    return plain(docs).repartition("doc_id")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, marked, excluded and after_refs of each line.

    The text is split together with a copy in which a mark follows every boundary (the text's start,
    a terminator or a blank line) and the white space and decoration after it.
    """
    marked = F.concat(F.lit(MARK), F.regexp_replace(F.translate("text", MARK, "\x02"), BOUNDARY, f"$0{MARK}"))
    parts = F.split("text", "\n")
    both = F.arrays_zip(parts.alias("line"), F.split(marked, "\n").alias("marked"))
    refs = F.array_position(F.transform(parts, lambda line: T.references_line(line)), True)  # 1-based, 0: none
    # two steps: beside a generator, refs would be evaluated for every line
    out = docs.select("doc_id", refs.alias("refs"), both.alias("both")).select("doc_id", "refs", F.posexplode("both").alias("line_no", "x"))
    return out.select("doc_id", "line_no", F.col("x.line").alias("line"), F.col("x.marked").alias("marked"), T.line_excluded(F.col("x.line")).alias("excluded"), ((F.col("refs") > 0) & (F.col("line_no") >= F.col("refs") - 1)).alias("after_refs"))


#: Characters of one run of the scan below (a longer text is one run), and bounds of what a worker gets at once.
RUN_CHARS, BATCH_ROWS, BATCH_BYTES = 1 << 19, 2000, 2 << 20
TOKENS = "struct<text:array<string>,start:array<int>,flags:array<tinyint>>"
IS_USABLE, AT_BOUNDARY, BESIDE = 1, 2, 4
TOKEN_CHAR, BLANK, NEUTRAL, STOP = 1, 2, 4, 8


@functools.cache
def _classes(spark: SparkSession) -> bytes:
    """The class bits of every code point, compressed; the JVM's engine says what a pattern's class holds, so that all patterns agree."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    pattern = spark._jvm.java.util.regex.Pattern
    table = np.zeros(0x110000, np.uint8)
    for bit, others in ((TOKEN_CHAR, T.NOT_TOKEN), (BLANK, f"[^{T.WS}]+"), (NEUTRAL, f"[^{T.DECORATION}{T.WS}_-]+"), (STOP, "[^.!?:]+")):
        table[[ord(c) for c in pattern.compile(others).matcher(every).replaceAll("")]] |= bit
    return zlib.compress(table.tobytes())


def scanned(texts: list[str], flags: np.ndarray, lines: np.ndarray, table: np.ndarray) -> pa.StructArray:
    """The tokens of each text. flags: of all their lines, `lines` of which are each text's: 1 excluded, 2 the head of a reference list.

    boundary: nothing but white space and decoration (and tokens of `-` and `_`, which are decoration
    too) stands between a boundary and the token. A boundary is the text's start, a terminator or a
    blank line. So the last character before the token that is a terminator, ends a blank line or is
    no decoration decides.
    """
    joined = "".join(texts)
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    raw = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    n, kind = len(point), table[point]
    # tokens: runs of their characters that don't go on from text to text
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind & TOKEN_CHAR > 0
    fresh = np.zeros(n + 1, bool)
    fresh[first] = True
    fresh[n] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (fresh | ~before))
    end = np.flatnonzero(before & (fresh | ~inside))
    doc = np.searchsorted(first, start, side="right") - 1  # of empty texts at one place, the last is the one with characters
    newline = np.flatnonzero(point == 10)
    line = np.searchsorted(newline, start) - np.searchsorted(newline, first)[doc]
    # what decides on boundaries
    solid = np.concatenate([[0], np.cumsum(kind & BLANK == 0)])  # characters before a place that are no white space
    owner = np.searchsorted(first, newline, side="right") - 1
    empty = newline[1:][(solid[newline[1:]] == solid[newline[:-1]]) & (owner[1:] == owner[:-1])]
    yes = kind & STOP > 0
    yes[empty] = True
    event = np.flatnonzero(yes | (kind & NEUTRAL == 0))
    last = np.searchsorted(event, start) - 1
    at = np.where(last >= 0, event[last] if len(event) else -1, -1)
    boundary = (at < first[doc]) | yes[at] if n else np.zeros(0, bool)
    heads, row = np.concatenate([[0], np.cumsum(flags & 2 > 0)]), np.cumsum(lines) - lines
    own = row[doc] + line
    usable = (flags[own] & 1 == 0) & (heads[own + 1] == heads[row[doc]])
    # strings, out of the bytes of the tokens alone
    wide = (1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(wide)])
    offsets = np.concatenate([[0], np.cumsum(place[end] - place[start])]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[np.repeat(inside[:n], wide)]))
    beside = np.zeros(len(start), bool)
    beside[:-1] = (start[1:] - end[:-1] == 1) & (doc[1:] == doc[:-1]) & usable[1:] & usable[:-1]
    cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]), pa.int32())
    bits = usable * IS_USABLE + boundary * AT_BOUNDARY + beside * BESIDE
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, x) for x in (text, pa.array(start - first[doc], pa.int32()), pa.array(bits, pa.int8()))], ["text", "start", "flags"])


def decoded(text: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in text.cast(pa.binary()).to_pylist()]


def runs(texts: list[str], lines: np.ndarray, flags: np.ndarray, table: np.ndarray):
    """Texts and their tokens, so many texts at once as a run has; lines and flags as in `scanned`."""
    size, stop, a, at = 0, np.cumsum(lines), 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= RUN_CHARS or k + 1 == len(texts):
            yield texts[a : k + 1], scanned(texts[a : k + 1], flags[at : stop[k]], lines[a : k + 1], table)
            size, a, at = 0, k + 1, stop[k]


def _scan(packed: bytes):
    def run(text: pa.Array, flags: pa.Array) -> pa.Array:
        table = np.frombuffer(zlib.decompress(packed), np.uint8)
        lines = pc.list_value_length(flags).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.concat_arrays([found for _, found in runs(decoded(text), lines, flags.flatten().to_numpy(zero_copy_only=False), table)])

    # annotations are strings in this module
    run.__annotations__ = {"text": pa.Array, "flags": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, TOKENS)


def batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds of what a worker gets at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def line_flags() -> Column:
    """Of each line of column text: 1 excluded, 2 the head of a reference list."""
    parts = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("line"), T.line_core(line).alias("core")))
    # two flags of a line in one number: a core is made once for both
    return F.transform(parts, lambda x: F.when(T.line_excluded(x.line, x.core), 1).otherwise(0) + F.when(T.references_line(x.line, x.core), 2).otherwise(0))


def tokens(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, text, lower, start, end, usable, boundary and then of each token.

    One scan of each text, where it is, without a row for what stands between tokens and without a
    sort. Its tokens are dealt out by doc_id as three arrays, the only shuffle that groupings and
    windows with doc_id in their keys need. `then` is the next token's text if both are usable and
    one character apart, else null. keep: several plans read them; the arrays are persisted.
    """
    batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins by doc_id and a word leave tokens where they are
    found = docs.select("doc_id", _scan(_classes(docs.sparkSession))("text", line_flags()).alias("t")).repartition("doc_id")
    found = found.persist() if keep else found
    each = F.arrays_zip(F.col("t.text").alias("text"), F.col("t.start").alias("start"), F.col("t.flags").alias("flags"), F.slice("t.text", 2, F.greatest(F.size("t.text"), F.lit(1))).alias("then"))
    out = found.select("doc_id", F.inline(each))
    has = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    return out.select("doc_id", "text", F.lower("text").alias("lower"), "start", (F.col("start") + F.length("text")).alias("end"), has(IS_USABLE).alias("usable"), has(AT_BOUNDARY).alias("boundary"), F.when(has(BESIDE), F.col("then")).alias("then"))


def forms(toks: DataFrame) -> DataFrame:
    """doc_id, text, lower, n, n_usable, interior (usable, not at a boundary), first and first_usable of each spelling; forms stay as they are."""
    if "first_usable" in toks.columns:
        return toks
    own = F.when(F.col("usable"), F.col("start"))
    return toks.groupBy("doc_id", "text", "lower").agg(F.count("*").alias("n"), F.count_if("usable").alias("n_usable"), F.count_if(F.col("usable") & ~F.col("boundary")).alias("interior"), F.min("start").alias("first"), F.min(own).alias("first_usable"))


def vocabulary(toks: DataFrame) -> DataFrame:
    """doc_id, lower, n, n_usable and first_start (first occurrence among all tokens) of tokens or their forms."""
    return forms(toks).groupBy("doc_id", "lower").agg(F.sum("n").alias("n"), F.sum("n_usable").alias("n_usable"), F.min("first").alias("first_start"))


def pairs(grams: DataFrame) -> DataFrame:
    """doc_id, w1, w2, n and start (the first) of each two words as written; pairs stay as they are."""
    return grams if "n" in grams.columns else grams.groupBy("doc_id", "w1", "w2").agg(F.count("*").alias("n"), F.min("start").alias("start"))


def bigrams(toks: DataFrame) -> DataFrame:
    """doc_id, w1, w2, start, end of usable content words one character apart."""
    content = lambda c: F.col(c).rlike(r"^[a-zA-Z]{3,}\z") & ~F.lower(c).isin(T.PHRASE_STOPWORDS)
    two = toks.where("then is not null").select("doc_id", F.col("text").alias("w1"), F.col("then").alias("w2"), "start", (F.col("end") + 1 + F.length("then")).alias("end"))
    return two.where(content("w1") & content("w2"))
