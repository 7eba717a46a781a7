"""Operator 1: line dedup by a segment-partition edit join.

A line of l characters is cut into EDITS + 1 segments. If two lines are at most EDITS edits apart,
one of the shorter line's segments stands unchanged in the longer one, within a few places of its
own. Each distinct line is indexed by its segments (with length and segment number) and probes with
the substrings that can match those of lines up to EDITS characters shorter, at the multi-match
aware positions. Keys are hashes, all made by built-in functions. Candidates are verified by a
banded bit-parallel edit distance, for many pairs at once.

Equal lines are one class before anything is joined. Within a bucket every class is compared with
the bucket's first indexed class; what links is one component, and just the buckets that still hold
several components are joined pairwise, large ones in blocks.

A line's place is its number in its text. Where ids repeat, 31 bits of the text's hash stand above
the number, which tells the texts of an id apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocked, free, load, narrowed, release, sampled, slices, tune, with_first
from .components import components

#: Edits (insertions, deletions, substitutions of characters) between near lines.
EDITS = 2
#: Characters of the shortest lines that are compared with edits; shorter ones are compared by equality.
#: Two edits change an eighth of such a line at most, and its segments still have 5 characters to select by.
MIN_NEAR = 16
#: What lines hold that are compared at all; those of white space alone separate others and stay.
SHOWN = r"[^ \t\r\f\x0B]"


# ---------------------------------------------------------------- verification


def within(xs: list[str], ys: list[str], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is at most `edits` edits apart.

    The band of 2 * edits + 1 rows around the diagonal is one bit vector a pair: bit k of column j
    is row j - edits + k. One step moves the vertical differences a row down and a column on;
    the distance on the main diagonal grows where the diagonal bit is not set.
    """
    out, todo = np.zeros(len(xs), bool), []
    for i, (x, y) in enumerate(zip(xs, ys)):
        if len(x) < len(y):
            x, y = y, x
        if len(x) - len(y) > edits:
            continue
        a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32) for t in (x, y))
        n = len(b)
        apart = np.flatnonzero(a[:n] != b)
        if not len(apart):
            out[i] = True
            continue
        a, b = a[apart[0] :], b[apart[0] :]
        n = len(b)
        apart = np.flatnonzero(a[len(a) - n :] != b)
        cut = n - 1 - int(apart[-1]) if len(apart) else n
        todo.append((i, a[: len(a) - cut], b[: n - cut]))
    todo.sort(key=lambda t: -len(t[2]))
    at = 0
    while at < len(todo):
        wide = len(todo[at][2]) + 3 * edits + 1
        own = todo[at : at + max(1, (1 << 21) // wide)]
        at += len(own)
        out[[t[0] for t in own]] = _band([t[1] for t in own], [t[2] for t in own], edits)
    return out


def _band(longs: list[np.ndarray], shorts: list[np.ndarray], edits: int) -> np.ndarray:
    """The pairs' shorts are in order of falling length."""
    count, columns = len(longs), len(shorts[0])
    m, n = np.array([len(a) for a in longs]), np.array([len(b) for b in shorts])
    rows = np.full((count, columns + 2 * edits + 1), -1, np.int32)  # rows[:, i + edits - 1] is character i of the long text
    text = np.full((count, columns), -2, np.int32)
    for i, (a, b) in enumerate(zip(longs, shorts)):
        rows[i, edits : edits + len(a)] = a[: columns + edits + 1]
        text[i, : len(b)] = b
    mask = np.uint64((1 << (2 * edits + 1)) - 1)
    top, one = np.uint64(1 << (2 * edits)), np.uint64(1)
    # column 0: D[i][0] = i below row 0; rows above it count as falling towards it
    vp = np.full(count, sum(1 << k for k in range(edits + 1, 2 * edits + 1)), np.uint64)
    vn = np.full(count, sum(1 << k for k in range(1, edits + 1)), np.uint64)
    dist, live = np.zeros(count, np.int64), count
    for j in range(columns):
        while live and n[live - 1] <= j:
            live -= 1
        if j % 32 == 31 and (dist[:live] > 2 * edits).all():
            dist[:live] = 99
            break
        p, q = vp[:live] >> one | top, vn[:live] >> one
        eq = np.zeros(live, np.uint64)
        for k in range(2 * edits + 1):
            eq |= (rows[:live, j + k] == text[:live, j]).astype(np.uint64) << np.uint64(k)
        same = ((((eq & p) + p) ^ p) | eq | q) & mask
        plus, minus = (q | ~(same | p)) & mask, same & p
        dist[:live] += (((same >> np.uint64(edits)) & one) ^ one).astype(np.int64)
        plus, minus = (plus << one | one) & mask, (minus << one) & mask
        vp[:live], vn[:live] = (minus | ~(eq | q | plus)) & mask, plus & (eq | q)
    # from row n down to row m in the last column
    for k in range(1, edits + 1):
        down = m - n >= k
        dist[down] += (vp[down] >> np.uint64(edits + k) & one).astype(np.int64) - (vn[down] >> np.uint64(edits + k) & one).astype(np.int64)
    return dist <= edits


# ---------------------------------------------------------------- the join


def _identity(line: str) -> list:
    """Two hashes and the length of a line; equal for equal lines only (to 128 bits)."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.col("len")]


def _keys(edits: int) -> Column:
    """Keys of column `line`, of `len` characters: those of its own segments first (index and probe), then more probes."""
    segments, own, more = edits + 1, [], []
    for delta in range(edits + 1):
        size = F.col("len") - delta  # of the indexed line
        for i in range(segments):
            base, longer = F.floor(size / segments).cast("int"), (size % segments).cast("int")
            width = base + F.when(longer >= segments - i, 1).otherwise(0)
            start = base * i + F.greatest(F.lit(0), longer - (segments - i))
            for move in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
                piece = F.substring(F.col("line"), (start + move + 1).cast("int"), width)
                (own if delta == 0 and move == 0 else more).append(F.xxhash64(size, F.lit(i), piece))
    return F.array(*own, *more)


def tagged(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text, tag), and whether ids repeat: only then is a tag more than 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeat = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    return docs.withColumn("tag", F.xxhash64("text").bitwiseAND((1 << 31) - 1) if repeat else F.lit(0).cast("long")), repeat


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, place and line of every line of (doc_id, text, tag)."""
    lines = docs.select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.shiftleft("tag", 32).bitwiseOR(F.col("line_no").cast("long")).alias("place"), "line")


def _line_no(place: Column) -> Column:
    return place.bitwiseAND((1 << 31) - 1).cast("int")


def _texts(docs: DataFrame, wanted: DataFrame, repeat: bool, scratch: Scratch, rows: int) -> DataFrame:
    """doc_id, place, line of the wanted (doc_id, place)."""
    by = scratch.keep(wanted.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "wanted", rows)
    got = narrowed(docs, by).select("doc_id", F.filter("places", lambda p: F.shiftright(p, 32) == F.col("tag")).alias("places"), F.split("text", "\n").alias("parts"))
    got = got.select("doc_id", F.explode(F.transform("places", lambda p: F.struct(p.alias("place"), F.get("parts", _line_no(p)).alias("line")))).alias("x")).select("doc_id", "x.place", "x.line").where("line is not null")
    return got.dropDuplicates(["doc_id", "place"]) if repeat else got


def bigram_parity(lines: list[str]) -> np.ndarray:
    """Parity of each line's character pairs in 64 bits: an edit flips 4 of them at most."""
    out = np.zeros(len(lines), np.int64)
    for i, t in enumerate(lines):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA6B))
        flips = np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(26), minlength=64) & 1
        out[i] = np.packbits(flips.astype(np.uint8)).view(np.int64)[0]
    return out


def _parities(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, ["line"])):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(bigram_parity(batch.column("line").to_pylist()))], ["doc_id", "place", "parity"])
        release()

    return texts.select("doc_id", "place", "line").mapInArrow(run, "doc_id long, place long, parity long")


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, ["x", "y"])):
            ok = within(batch.column("x").to_pylist(), batch.column("y").to_pylist(), edits)
            yield batch.select(["a_doc", "a_place", "b_doc", "b_place"]).filter(pa.array(ok, pa.bool_()))
        release()

    side = lambda x, t: texts.select(F.col("doc_id").alias(f"{x}_doc"), F.col("place").alias(f"{x}_place"), F.col("line").alias(t))
    both = pairs.join(side("a", "x"), ["a_doc", "a_place"]).join(side("b", "y"), ["b_doc", "b_place"])
    return both.select("a_doc", "a_place", "b_doc", "b_place", "x", "y").mapInArrow(run, "a_doc long, a_place long, b_doc long, b_place long")


def _node(doc: str, place: str) -> Column:
    return F.struct(F.col(doc).alias("doc_id"), F.col(place).alias("place"))


def repeated_lines(docs: DataFrame, repeat: bool, edits: int = EDITS, min_near: int = MIN_NEAR) -> DataFrame:
    """(doc_id, place, first_doc, first_place) of every line of (doc_id, text, tag) that is not the first of its class.

    A class is a component of lines linked by at most `edits` edits (lines of min_near characters or
    more) or equality (any that show something); first is by doc_id, then place. Null texts have no
    lines; rows that repeat an id and its text are one document; rows without an id take part by
    equality only, and are first only where no line of the class has an id.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "lines")
    # one shuffle for classes and keys; copies of a line meet before it
    lines = lines_of(docs).where(F.col("line").rlike(SHOWN)).withColumn("len", F.length("line"))
    lines = lines.select("doc_id", "place", *_identity("line"), F.when(F.col("len") >= max(min_near, edits + 1), _keys(edits)).alias("keys"))
    at = F.struct("doc_id", "place")
    first = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), at)), F.min(at))
    classes = lines.groupBy("h1", "h2", "len").agg(first.alias("first"), F.count("*").alias("copies"), F.first("keys", ignorenulls=True).alias("keys"))
    classes = scratch.keep(classes, "classes")
    free(spark)
    indexed = classes.where("first.doc_id is not null")
    keyed = lambda df: df.select("first.doc_id", "first.place", F.posexplode("keys").alias("at", "key")).select("key", (F.col("at") > edits).cast("int").alias("probe"), "doc_id", "place")
    shared = with_first(keyed(indexed), keyed(sampled(indexed, F.col("first"))), ["probe", "doc_id", "place"], scratch, "keys").where("p_probe = 0")
    shared = scratch.keep(shared.drop("p_probe").withColumnsRenamed({"p_doc_id": "p_doc"}), "shared")
    free(spark)
    n = shared.count()

    swap = _node("p_doc", "p_place") < _node("doc_id", "place")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    paired = lambda df: df.select(pick("p_doc", "doc_id").alias("a_doc"), pick("p_place", "place").alias("a_place"), pick("doc_id", "p_doc").alias("b_doc"), pick("place", "p_place").alias("b_place")).distinct()
    stars = scratch.keep(paired(shared.where(_node("p_doc", "p_place") != _node("doc_id", "place"))), "stars", n)
    ends = stars.select(F.col("a_doc").alias("doc_id"), F.col("a_place").alias("place")).unionByName(stars.select(F.col("b_doc").alias("doc_id"), F.col("b_place").alias("place"))).distinct()
    n_stars = stars.count()
    texts = scratch.keep(_texts(docs, ends, repeat, scratch, n_stars), "star_texts")
    links = scratch.keep(_verified(stars, texts, edits), "star_links", n_stars, 10_000)
    free(spark)
    edges = lambda p: p.select(_node("a_doc", "a_place").alias("u"), _node("b_doc", "b_place").alias("v"))
    n_links = links.count()
    found = scratch.keep(components(edges(links), scratch, "star"), "star_components", 2 * n_links)

    # buckets in which a class is apart from the pivot's component, pairwise: an indexed line and any other
    rest = shared.withColumn("node", _node("doc_id", "place")).join(found.withColumnRenamed("component", "c"), "node", "left")
    rest = rest.withColumn("pivot", _node("p_doc", "p_place")).join(found.select(F.col("node").alias("pivot"), F.col("component").alias("p")), "pivot", "left")
    rest = rest.select("key", "probe", "doc_id", "place", F.coalesce("c", "node").alias("c"), F.coalesce("p", "pivot").alias("p"))
    apart = scratch.keep(rest.where("c <> p").select("key").distinct(), "apart", n)
    rest = scratch.keep(rest.join(apart, "key", "left_semi").drop("p"), "rest", n)
    # parities decide within the join, so it puts out no more than pairs that may well link
    rest = blocked(rest, "key", F.struct("doc_id", "place"), scratch, "rest").join(_parities(texts), ["doc_id", "place"])
    x = rest.where("probe = 0").select("key", "cell", F.col("side").alias("side_p"), F.col("doc_id").alias("p_doc"), F.col("place").alias("p_place"), F.col("c").alias("c_p"), F.col("parity").alias("parity_p"))
    once = (F.col("side") == 2) | (F.col("side") != F.col("side_p"))
    pairs = paired(x.join(rest, ["key", "cell"]).where(once & (F.col("c") != F.col("c_p")) & (F.bit_count(F.col("parity").bitwiseXOR(F.col("parity_p"))) <= 4 * edits)))
    pairs = scratch.keep(pairs.join(stars, ["a_doc", "a_place", "b_doc", "b_place"], "left_anti"), "pairs")
    scratch.drop("shared", "rest", "apart")
    if n_pairs := pairs.count():
        more = scratch.keep(_verified(pairs, texts, edits), "pair_links", n_pairs, 10_000)  # all ends of pairs are ends of stars
        if n_more := more.count():
            found = scratch.keep(components(edges(links.unionByName(more)), scratch, "all"), "components", 2 * (n_links + n_more))
    free(spark)

    # classes whose lines are not all first
    head = classes.join(found.select(F.col("node").alias("first"), "component"), "first", "left").withColumn("head", F.coalesce("component", "first"))
    head = scratch.keep(head.where((F.col("copies") > 1) | (F.col("head") != F.col("first"))).select("h1", "h2", "len", "head"), "heads")
    gone = lines.drop("keys").join(head, ["h1", "h2", "len"]).where(~_node("doc_id", "place").eqNullSafe(F.col("head")))
    gone = scratch.keep(gone.select("doc_id", "place", F.col("head.doc_id").alias("first_doc"), F.col("head.place").alias("first_place")), "repeated")
    scratch.drop(*(x for x in scratch.labels() if x != "repeated"))
    return gone


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_near: int = MIN_NEAR) -> DataFrame:
    """All rows and columns of docs, the text without repeated lines, plus n_lines and removed.

    removed: array of (line_no, first_doc, first_line), by line_no. A text that loses all its lines
    is empty; a null text stays null with 0 lines; an empty text has one (empty, kept) line. Rows
    that repeat an id and its text lose the same lines; texts that share an id are documents of
    their own, in an order of their hashes; rows without an id are compared by equality only.
    Columns named n_lines or removed are replaced; an empty table gives no rows.
    """
    texts, repeat = tagged(docs)
    gone = repeated_lines(texts, repeat, edits, min_near)
    gone = gone.select("doc_id", F.shiftright("place", 32).alias("tag"), F.struct(_line_no(F.col("place")).alias("line_no"), "first_doc", _line_no(F.col("first_place")).alias("first_line")).alias("x"))
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag")).agg(F.sort_array(F.collect_set("x")).alias("removed"))
    docs = docs.drop("n_lines", "removed")
    same = docs.doc_id.cast("long").eqNullSafe(F.col("_gone_id"))
    if repeat:
        same &= F.xxhash64(docs.text).bitwiseAND((1 << 31) - 1) == F.col("_gone_tag")
    out = docs.join(gone, same, "left").drop("_gone_id", "_gone_tag")
    parts = F.split("text", "\n")
    numbers = F.transform("removed", lambda r: r.line_no)
    # the runs of lines between removed ones, so that long texts take linear time
    runs = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(numbers, lambda k: k + 1)), F.concat(numbers, F.array(F.size(parts))), lambda a, b: F.slice(parts, a + 1, b - a))
    kept = F.array_join(F.flatten(runs), "\n")
    return out.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"), "text": F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept), "removed": F.coalesce("removed", F.array().cast("array<struct<line_no:int,first_doc:bigint,first_line:int>>"))})


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r.line_no, r.first_doc, r.first_line)), ",").alias("removed"), "text")


ORACLE = f"""
with recursive l as (select doc_id, unnest(range(len(p))) as k, unnest(p) as t from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null)),
c as (select t, min((doc_id, k)) as first, length(t) as n from l where regexp_matches(t, '{SHOWN}') group by t),
e as (select a.first as u, b.first as v from c a join c b on a.n >= {MIN_NEAR} and b.n >= {MIN_NEAR} and b.n - a.n between 0 and {EDITS} and a.first <> b.first
    where (contains(b.t, a.t[1 : a.n // 3]) or contains(b.t, a.t[a.n // 3 + 1 : 2 * (a.n // 3)]) or contains(b.t, a.t[2 * (a.n // 3) + 1 : a.n])) and levenshtein(a.t, b.t) <= {EDITS}),
s as (select u, v from e union select v, u from e),
r as (select u as node, v as head from s union select r.node, s.v from r join s on s.u = r.head),
h as (select c.t, least(c.first, coalesce(min(r.head), c.first)) as head from c left join r on r.node = c.first group by c.t, c.first),
m as (select l.doc_id, l.k, l.t, h.head, h.head is not null and h.head <> (l.doc_id, l.k) as gone from l left join h on h.t = l.t),
g as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, string_agg(k || ':' || struct_extract_at(head, 1) || ':' || struct_extract_at(head, 2), ',' order by k) filter (gone) as removed, string_agg(t, chr(10) order by k) filter (not gone) as t from m group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed, case when d.text is null then null else coalesce(t, '') end as text
from documents d left join g on g.doc_id = d.doc_id
"""
