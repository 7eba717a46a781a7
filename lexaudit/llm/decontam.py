"""Operator 8: benchmark decontamination with one Aho-Corasick automaton.

Texts and test items are normalised alike: A-Z lower-cased, words are runs of digits, lower-case
letters and non-ASCII bytes, joined by single blanks. What is looked for is every window of WINDOW
consecutive item words; an item of fewer words is one window. The automaton holds an anchor of
ANCHOR words, with a blank on either side, at every STEP-th place of an item, about a node for each
byte of it: a window holds an anchor whole, so at an anchor's occurrence the windows around it are
looked up by their hashes and compared word by word. A text is scanned once; matches are mapped back
to character offsets in the original text. It is a map without any shuffle.

The items are broadcast, and a worker keeps one automaton, while their texts have up to ITEM_BYTES
together. Larger benchmarks are dealt into parts of that size, one automaton each; the documents
pass them one after the other, as tables in the shared folder, so memory stays bounded.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, load, mix, release, tune

WINDOW = 10
#: Words of an anchor and the distance between anchors; a window is no shorter than both less one.
ANCHOR, STEP = 5, 5
#: Bytes of the item texts of one automaton.
ITEM_BYTES = 2 << 20
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Matcher:
    """Finds the windows of items (item_id, text) in texts. Null ids mark hits but count as no item."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        import ahocorasick

        self.window, self.anchor = window, min(ANCHOR, window)
        step = min(STEP, window - self.anchor + 1)
        self.number: dict[bytes, int] = {}  # from 1; 0 is no item's word
        self.short: dict[bytes, set] = {}  # whole items of fewer words than a window
        self.machine = ahocorasick.Automaton()
        spans, self.names, flat, at = [], [], [], 0
        for item_id, text in items:
            words = normal_words(text)
            name = None if item_id is None else str(item_id)
            if 0 < len(words) < window:
                self.short.setdefault(b" ".join(words), set()).add(name)
            elif words:
                flat.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint32))
                spans.append((at, at + len(words) - window + 1))
                self.names.append(name)
                at += len(words)
                for k in range(0, len(words) - self.anchor + 1, step):
                    self.machine.add_word(self._line(words[k : k + self.anchor]), 0)
        for own in self.short:  # an anchor may be a short item as well
            words = own.split(b" ")
            self.machine.add_word(self._line(words), len(words))
        self.machine.make_automaton()
        self.words = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        # every window once, by hash: where it stands, and the items that have it
        first = np.concatenate([np.arange(a, b) for a, b in spans] or [np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(spans)), [b - a for a, b in spans])
        key = self._keys(self.words, max(0, len(self.words) - window + 1))[first]
        by = np.lexsort((item, key))
        key, first, item = key[by], first[by], item[by]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key, self.first = key[new], first[new]
        self.cut, self.item = np.append(new, len(key)), item

    @staticmethod
    def _line(words: list[bytes]) -> str:
        return (b" " + b" ".join(words) + b" ").decode("latin-1")

    def _keys(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of n windows: their words k from place k on."""
        h = np.zeros(n, np.uint64)
        for k in range(self.window if n else 0):
            h = mix((h ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        return h

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, list[str]]]]:
        """(words of the text, [(first word, end word, item ids)] of every occurrence of a window)."""
        words = normal_words(text)
        if not words or not len(self.machine):
            return len(words), []
        met = list(self.machine.iter(self._line(words)))
        if not met:
            return len(words), []
        ends = np.cumsum([len(w) + 1 for w in words])  # place of the blank after each word
        found, starts = [], set()
        for last, (_, n) in zip(np.searchsorted(ends, [end for end, _ in met]).tolist(), met):
            if n:
                found.append((last + 1 - n, last + 1, self._ids(self.short[b" ".join(words[last + 1 - n : last + 1])])))
            if n in (0, self.anchor):  # windows that hold the anchor
                starts.update(range(max(0, last + 1 - self.window), min(last + 1 - self.anchor, len(words) - self.window) + 1))
        if starts and len(self.key):
            number = self.number.get
            at, line = np.array(sorted(starts)), np.array([number(w, 0) for w in words], np.uint32)
            h = self._keys(line, len(line) - self.window + 1)[at]
            k = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            place = np.arange(self.window)
            same = (self.words[self.first[k][:, None] + place] == line[at[:, None] + place]).all(axis=1)
            for a, i in zip(at[same].tolist(), k[same].tolist()):
                found.append((a, a + self.window, self._ids({self.names[j] for j in self.item[self.cut[i] : self.cut[i + 1]].tolist()})))
        return len(words), found

    @staticmethod
    def _ids(names: set) -> list[str]:
        return sorted(x for x in names if x is not None)


def word_offsets(text: str) -> np.ndarray:
    """(start, end) of every normalised word in the original text, in characters."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw.translate(_TABLE), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], b.view(np.int8), [0]]))
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return np.stack([chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]], axis=1)


_matchers: dict[str, Matcher] = {}


def matcher(key: str, told, window: int) -> Matcher:
    """The matcher of one broadcast part of the items; a worker keeps one."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(told.value, window)
    return _matchers[key]


def _pieces(text: str, window: int, item_bytes: int):
    """A text longer than item_bytes in pieces that overlap by a window less a word, so that they hold every window."""
    if len(text) * 4 <= item_bytes or len(text.encode("utf-8", "surrogatepass")) <= item_bytes:
        yield text
        return
    words = normal_words(text)
    ends = np.cumsum([len(w) + 1 for w in words])
    a = 0
    while a < len(words):
        b = max(a + window, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + item_bytes, side="right")))
        yield b" ".join(words[a:b]).decode("utf-8", "surrogatepass")
        if b >= len(words):
            return
        a = b - window + 1


def _parts(benchmark: DataFrame, window: int, item_bytes: int):
    """Lists of (item_id, text) of so many bytes together; one list is on the driver at a time."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        for text in _pieces(r.text, window, item_bytes):
            own = len(text.encode("utf-8", "surrogatepass")) + 1
            if part and size + own > item_bytes:
                yield part
                part, size = [], 0
            part.append((r.item_id, text))
            size += own
    yield part


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """All columns of docs plus n_words, n_hit, items (sorted ids as strings), spans and contaminated.

    spans are maximal runs of hit words as (start, end) character offsets in the original text.
    Null texts have no words and no hits; items without words have no window; repeated rows are
    judged each; an empty benchmark contaminates nothing; an empty table gives no rows. Columns of
    docs named like the new ones are replaced.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    columns, tag, scratch = docs.columns, uuid.uuid4().hex, Scratch(spark, "decontam")
    met = T.StructType([T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    passed = T.StructType([*docs.schema.fields, T.StructField(f"_met_{tag}", met)])
    judged = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)])

    def scanner(told, key: str, again: bool, last: bool):
        """A pass: what earlier parts met comes in a column if there were any, and goes on in it unless this is the last."""

        def run(batches):
            for batch in batches:
                own = matcher(key, told, window)
                texts = batch.column("text").to_pylist()
                before = batch.column(f"_met_{tag}").to_pylist() if again else [None] * len(texts)
                out: dict[str, list] = {"n_words": [], "n_hit": [], "items": [], "spans": []}
                runs_of = []
                for t, old in zip(texts, before):
                    n, found = own.scan(t)
                    hits = [(a, b) for a, b, _ in found]
                    items = {i for _, _, ids in found for i in ids}
                    if old:
                        hits += zip(old["runs"][::2], old["runs"][1::2])
                        items.update(old["items"])
                    runs: list[list[int]] = []
                    for a, b in sorted(hits):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    runs_of.append([x for r in runs for x in r])
                    out["items"].append(sorted(items))
                    out["n_words"].append(n)
                    out["n_hit"].append(sum(b - a for a, b in runs))
                    at = word_offsets(t) if runs and last else None
                    out["spans"].append([{"start": int(at[a][0]), "end": int(at[b - 1][1])} for a, b in runs] if last else None)
                kept = [batch.column(c) for c in columns]
                if last:
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=[*columns, *out])
                else:
                    kind = pa.struct([("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([{"runs": r, "items": i} for r, i in zip(runs_of, out["items"])], kind)], names=[*columns, f"_met_{tag}"])
            release()

        return run

    k, parts = 0, _parts(benchmark, window, item_bytes)
    part = next(parts)
    while part is not None:
        then = next(parts, None)
        told = spark.sparkContext.broadcast(part)  # of about item_bytes
        run = scanner(told, f"{tag}-{k}", k > 0, then is None)
        docs = docs.mapInArrow(run, judged if then is None else passed)
        if then is not None:
            docs = scratch.keep(docs, f"part-{k}")
            if k:
                scratch.drop(f"part-{k - 1}")
        part, k = then, k + 1
    return docs.withColumn("contaminated", F.col("n_hit") > 0)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _grams(n: int) -> str:
    """Windows of n words: those of items, and where documents have them."""
    size = "len(w) >= 10" if n == WINDOW else f"len(w) = {n}"
    return f"""
    select d.doc_id, p, {n} as n, i.item_id
    from (select doc_id, p, array_to_string(w[p + 1 : p + {n}], ' ') as g from (select doc_id, w, unnest(range(len(w) - {n} + 1)) as p from dw where len(w) >= {n})) d
    join (select distinct item_id, array_to_string(w[p + 1 : p + {n}], ' ') as g from (select item_id, w, unnest(range(len(w) - {n} + 1)) as p from bw where {size})) i on d.g = i.g"""


ORACLE = f"""
with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
bw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
hit as ({' union all '.join(_grams(n) for n in range(1, WINDOW + 1))}),
words as (select doc_id, count(distinct p + k) as n_hit from (select doc_id, p, unnest(range(n)) as k from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words on words.doc_id = dw.doc_id left join items on items.doc_id = dw.doc_id
"""
