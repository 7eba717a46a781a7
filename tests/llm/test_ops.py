"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from lexaudit.llm import bpe, chat, common, components, decontam, embeddings, jaccard, langid, lines, packing, resample, rollup, shingles, tokens
from lexaudit.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", 0) for i, t in texts], schema)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): singles, exact and near copies, shared lines, nulls, empty and odd texts."""
    rng = random.Random(11)
    out = []
    for i in range(60):
        out.append((i, "\n".join(words(rng, rng.randint(3, 60), 4000) for _ in range(rng.randint(1, 4)))))
    base = words(rng, 120, 4000)
    for i in range(60, 75):
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        out.append((i, " ".join(w)))
    passage = words(rng, 45, 4000)
    out += [(i, passage + " " + words(rng, 12, 4000)) for i in range(75, 90)]
    out += [(90, None), (91, ""), (92, " \n\t "), (93, "one two"), (94, "ONE  two"), (95, "x" * 200_000), (96, "é漢字 \x1c " * 50), (97, out[3][1]), (None, out[4][1]), (None, None), (98, "an <|endoftext|> inside<|endoftext|>\n<|endoftext|>")]
    return out


def tables(spark, path, **made):
    """A folder of tables as queries read them."""
    for name, df in made.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return f"file://{path}"


def clash(df, *names):
    """df with columns that are named like those an operator makes."""
    return df.withColumns({n: F.lit("mine") for n in names})


def test_scratch_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    scratch = Scratch(spark, "t")
    scratch.keep(spark.range(3), "a")
    assert scratch.labels() == ["a"]
    scratch.drop("a")
    assert scratch.labels() == []


@pytest.mark.parametrize("hot", [5, 10**9])
def test_first_of_a_key(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = [(i % 3 if i < 60 else i, i * 7919 % 1000) for i in range(70)]
    df = spark.createDataFrame(rows, "key long, x long")
    got = {(r.key, r.x, r.p_x) for r in common.with_first(df, df, ["x"], Scratch(spark, "f"), "f").collect()}
    least = {k: min(x for q, x in rows if q == k) for k, _ in rows}
    assert got == {(k, x, least[k]) for k, x in rows if k < 3}


def test_blocks_of_a_key(spark):
    rows = [(1, i) for i in range(50)] + [(2, i) for i in range(7)] + [(3, 0)]
    dealt = common.blocked(spark.createDataFrame(rows, "key long, x long"), "key", F.col("x"), Scratch(spark, "b"), "b", block=8)
    a, b = (dealt.select("key", "cell", *(F.col(c).alias(f"{c}_{i}") for c in ("x", "side"))) for i in "ab")
    once = ((F.col("side_a") == 2) & (F.col("x_a") < F.col("x_b"))) | ((F.col("side_a") == 0) & (F.col("side_b") == 1))
    pairs = [(r.key, *sorted((r.x_a, r.x_b))) for r in a.join(b, ["key", "cell"]).where(once).collect()]
    assert sorted(pairs) == sorted((k, i, j) for k, n in ((1, 50), (2, 7)) for j in range(n) for i in range(j))
    assert dealt.groupBy("key", "cell").count().agg(F.max("count")).first()[0] <= 40


# ---------------------------------------------------------------- encoding


def test_chunks_encode_as_whole_texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b's", "'re", "1", "é", " ", "\x1c", ".", "the", "<|endoftext|>", "漢", " \n", "Bc", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + [None, ""]
    enc, plain = bpe.ChunkEncoder(bpe.default_path(), limit=3000), fresh()
    for k in range(0, len(texts), 1000):
        some = texts[k : k + 1000]
        ids, n = enc.encode(some)
        want = [e.ids for e in plain.encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_encoder_forgets(spark):
    enc = bpe.ChunkEncoder(bpe.default_path(), kept=50, most=2000)
    for k in range(20):
        enc.encode([f"the word{k} " * 3, f"u{k}" * 300])
        assert enc.held < 5000
    enc.rest_now()
    assert enc.size <= 50 and enc.encode(["the word3"])[0].tolist() == fresh().encode("the word3").ids


def fresh():
    """The library as it is."""
    return Tokenizer.from_file(bpe.default_path())


def whole(texts):
    plain = fresh()
    return [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---------------------------------------------------------------- 1


def near(a, b, edits):
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1] <= edits


def test_banded_distance():
    rng = random.Random(3)
    pairs = []
    for _ in range(1500):
        a = [rng.choice("abé漢") for _ in range(rng.randint(0, 50))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        pairs.append(("".join(a), "".join(b)))
    for edits in (1, 2, 3):
        assert lines.within([a for a, _ in pairs], [b for _, b in pairs], edits).tolist() == [near(a, b, edits) for a, b in pairs]
    parities = lines.bigram_parity([a for a, _ in pairs]), lines.bigram_parity([b for _, b in pairs])
    for (a, b), x, y in zip(pairs, *parities):
        if near(a, b, 2):
            assert bin((int(x) ^ int(y)) & (1 << 64) - 1).count("1") <= 8


def line_classes(rows):
    """(doc_id, line number) -> that of the first of its class, by definition."""
    all_lines = [((d, k), line) for d, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    parent = {n: n for n, _ in all_lines}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, (m, x) in enumerate(all_lines):
        for n, y in all_lines[:i]:
            if (x == y and x.strip(" \t\r\f\x0b")) or (min(len(x), len(y)) >= lines.MIN_NEAR and max(len(x), len(y)) < 10_000 and near(x, y, 2)) or {m[0], n[0]} == {103, 104}:
                a, b = find(m), find(n)
                parent[max(a, b)] = min(a, b)
    return find


def test_line_dedup(spark, monkeypatch):
    # keys count as hot, buckets are dealt into blocks; the pipeline's test goes the usual way
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "SAMPLED", 1)
    monkeypatch.setattr(lines, "blocked", lambda *a: common.blocked(*a, block=4))
    rng = random.Random(7)
    kinds = [words(rng, 12) for _ in range(30)]
    rows = []
    for d in range(40):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice([rng.choice(kinds), "short", " \t", "}", "a line of twenty chars", "one of 16 letter", words(rng, 15)])
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(line))
                line = line[:k] + rng.choice(["", "q", "qq"]) + line[k + rng.randint(0, 1) :]
            own.append(line)
        rows.append((d, "\n".join(own)))
    head = words(rng, 20)
    rows += [(50 + k, head + " " + words(rng, 10)[:40].ljust(40, "x")) for k in range(12)]  # a segment that strangers share
    rows += [(100, None), (101, ""), (102, "\n"), (103, "y" * 50_000), (104, "y" * 49_999), (-(1 << 63), kinds[0] + "!")]
    find = line_classes(rows)
    docs = clash(frame(spark, rows), "removed", "n_lines", "place", "tag", "line", "keys")
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert sum(len(r.removed) for r in got.values()) > 20
    for d, t in rows:
        own = [] if t is None else t.split("\n")
        gone = {k: find((d, k)) for k in range(len(own)) if find((d, k)) != (d, k)}
        assert {x.line_no: (x.first_doc, x.first_line) for x in got[d].removed} == gone
        assert got[d].text == (None if t is None else "\n".join(x for k, x in enumerate(own) if k not in gone))
        assert got[d].n_lines == len(own) and got[d].place == "mine"
    assert lines.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    line, other = "a line that is long enough to be compared with edits", "something else that stands in another text alone"
    rows = [(1, line), (5, line + "\nown"), (5, other + "\nown too"), (7, other + "."), (8, "twice"), (8, "twice"), (None, "x\n" + line), (None, other + "\ny")]
    got = sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([(1, line), (5, "own"), (5, other + "\nown too"), (7, ""), (8, "twice"), (8, "twice"), (0, "x"), (0, "y")])


def test_line_dedup_with_other_floors(spark):
    rows = [(1, "abcdefgh"), (2, "abcdefg"), (3, "abXdeYgh"), (4, "zzzzzzzz")]
    of = lambda **k: {r.doc_id for r in lines.dedup_lines(frame(spark, rows), **k).collect() if r.removed}
    assert of(min_near=6) == {2, 3} and of(min_near=6, edits=1) == {2}


def test_lines_without_an_id_hide_no_near_lines(spark):
    line, alone = "a line that is long enough to be compared with edits", "only rows without an id hold this line"
    rows = [(None, line + "\n" + alone), (3, line), (4, line + "!"), (5, "!" + line + "\nown text of five")]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {None: [(0, 3, 0)], 3: [], 4: [(0, 3, 0)], 5: [(0, 3, 0)]}


# ---------------------------------------------------------------- 2


def test_token_files(spark, corpus, tmp_path):
    docs = frame(spark, corpus)
    path = f"file://{tmp_path}/ids"
    tokens.write_tokens(docs, path, shard_tokens=3000)
    ordered = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = [(i, crc(ids), len(ids)) for (i, _), ids in zip(ordered, whole([t for _, t in ordered]))]
    shards = [tokens.unpack(r.asDict()) | {"at": (r.shard, r.part)} for r in spark.read.schema(tokens.SHARD).parquet(path).collect()]
    shards.sort(key=lambda s: s["at"])
    got, flat = [], [x for ids in whole([t for _, t in ordered]) for x in ids]
    at = 0
    for s in shards:
        ids = tokens.expand(s["symbols"], s["rules"], s["base"])
        for d, n in enumerate(s["doc_tokens"].tolist()):
            start = int(s["doc_tokens"][:d].sum())
            own = ids[start : start + n]
            got.append((None if s["doc_null"][d] else int(s["doc_ids"][d]), crc(own), n))
            a = n // 3
            assert tokens.read_span(s, d, a, min(20, n - a)).tolist() == flat[at + a : at + a + min(20, n - a)]
            at += n
    assert got == want
    assert sum(len(s["rules"]) for s in shards) > 0
    read = Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in tokens.read_tokens(spark, path).collect())
    assert read == Counter(want)


def test_token_query(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 3000)  # several shards a task
    known = [(i, t) for i, t in corpus if i is not None]
    got = tokens.op2_token_ids(spark, tables(spark, tmp_path, documents=clash(frame(spark, known), "shard", "part"))).collect()
    at, want = 0, []
    for i, ids in zip(sorted(i for i, _ in known), whole([t for _, t in sorted(known, key=lambda r: r[0])])):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    empty = tables(spark, tmp_path / "none", documents=frame(spark, []))
    assert tokens.op2_token_ids(spark, empty).count() == 0


def test_repair_keeps_documents_apart():
    rng = np.random.default_rng(4)
    ids, n = rng.integers(0, 6, 5000).astype(np.uint32), np.full(100, 50)
    seq, sizes, rules, lengths = tokens.compress(ids, n, 6, least=2)
    assert (tokens.expand(seq, rules, 6) == ids).all() and len(seq) < 3500
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for d in range(100):
        assert (tokens.expand(seq[ends[d] : ends[d + 1]], rules, 6) == ids[50 * d : 50 * d + 50]).all()
    assert [len(tokens.expand(np.array([6 + k]), rules, 6)) for k in range(len(rules))] == lengths.tolist()


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 40_000), 5000).astype(np.uint32)
    ids[:300] = 7  # runs of one symbol
    n = np.full(80, 500)
    seq, sizes, rules, _ = tokens.compress(ids, n, 5001)
    assert (tokens.expand(seq, rules, 5001) == ids).all()
    count = Counter()
    for own in np.split(seq, np.cumsum(sizes)[:-1]):
        last, k = own.tolist(), 0
        while k < len(last) - 1:
            count[last[k], last[k + 1]] += 1
            k += 1 + (last[k : k + 3] == [last[k]] * 3)  # aaa holds one aa
    assert max(count.values()) < tokens.LEAST


def test_a_word_is_encoded_once_whatever_follows_it():
    class Model:
        def __init__(self, model):
            self.model, self.calls = model, []

        def tokenize(self, word):
            self.calls.append(word)
            return self.model.tokenize(word)

    class Counted:
        def __init__(self, tok):
            self.tok, self.model = tok, Model(tok.model)

        def __getattr__(self, name):
            return getattr(self.tok, name)

    enc = bpe.ChunkEncoder(bpe.default_path())
    enc.tok = Counted(enc.tok)
    texts = ["a quirkword\nquirkword z", None, "a quirkword, (quirkword quirkword!? quirkword.\nquirkword;' quirkword's quirkword''' b", "", "a  quirkword%%% \n quirkword\t", "éa漢-- é漢 é漢-- é漢,\x00"]
    for own in (texts[:2], texts[2:]):
        flat, n = enc.encode(own)
        want = [enc.tok.tok.encode(t or "", add_special_tokens=False).ids for t in own]
        assert flat.tolist() == [x for ids in want for x in ids] and n.tolist() == [len(ids) for ids in want]
    assert enc.tok.model.calls.count("Ġquirkword") == enc.tok.model.calls.count("quirkword") == 1


def test_rules_expand_with_and_without_lengths():
    rng = np.random.default_rng(6)
    for k in range(40):
        ids = rng.integers(0, 1 + k % 5, 1 + 9 * k).astype(np.uint32)
        seq, _, rules, lengths = tokens.compress(ids, np.array([len(ids)]), 6, least=2)
        assert (tokens.expand(seq, rules, 6, lengths) == ids).all() and (tokens.expand(seq, rules, 6) == ids).all()
        assert not len(tokens.expand(seq[:0], rules, 6))


def test_token_symbols_are_wide_where_16_bits_run_out():
    for n_ids in (100, 65_530, 70_000):
        symbols, rules = np.concatenate([np.arange(n_ids), 80_000 + np.arange(10)]).astype(np.uint32), np.arange(20, dtype=np.uint32).reshape(-1, 2)
        made = tokens.narrow(symbols, rules, 80_000)
        assert made["wide"] == (n_ids + 10 > 1 << 16)
        got = tokens.unpack(made | {"base": 80_000, "lengths": np.full(10, 2, "<u4").tobytes()} | {c: b"" for c in ("doc_ids", "doc_null", "doc_symbols", "doc_tokens")})
        assert (got["symbols"] == symbols).all() and (got["rules"] == rules).all()


# ---------------------------------------------------------------- 3, 4


def test_resampling(spark, corpus):
    docs = frame(spark, corpus)
    ids = spark.createDataFrame([(i,) for i in range(0, 20)] + [(None,)], "doc_id long")
    got = resample.resample(docs, ids, 0.5).collect()
    assert len(got) == len(corpus) and sorted(r.rank for r in got) == list(range(1, len(got) + 1))
    assert [r.gumbel_key for r in sorted(got, key=lambda r: r.rank)] == sorted((r.gumbel_key for r in got), reverse=True)
    assert sum(r.selected for r in got) == round(0.5 * len(got)) and all(r.selected == (r.rank <= round(0.5 * len(got))) for r in got)
    raw, target = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    grams = {k: resample.gram_buckets(shingles.word_hashes([t])[0]) for k, (_, t) in enumerate(corpus)}
    for k, (i, _) in enumerate(corpus):
        n = np.bincount(grams[k], minlength=resample.BUCKETS)
        raw += n
        target += n * (i is not None and i < 20)
    log = lambda c: np.log(c + 1) - np.log(c.sum() + resample.BUCKETS)
    ratio = log(target) - log(raw)
    want = sorted((i if i is not None else -1, round(float(ratio[grams[k]].sum()), 6)) for k, (i, _) in enumerate(corpus))
    assert sorted((r.doc_id if r.doc_id is not None else -1, round(r.log_weight, 6)) for r in got) == want
    mean = lambda some: np.mean([r.log_weight for r in got if r.doc_id is not None and r.n_grams and some(r.doc_id)])
    assert mean(lambda i: i < 20) > mean(lambda i: 20 <= i < 90)
    assert resample.resample(docs.limit(0), ids).count() == 0
    again = resample.resample(clash(docs, "rank", "noise", "n_grams", "part", "place"), ids, 0.5).collect()
    assert sorted((r.gumbel_key, r.rank) for r in again) == sorted((r.gumbel_key, r.rank) for r in got)
    noise = [r.gumbel_key - r.log_weight for r in got if r.doc_id is None]
    assert len(set(noise)) == len(noise)  # rows without an id have noise of their own
    assert all(r.log_weight == 0 for r in resample.resample(docs, ids.limit(0)).collect())


def test_rollups(spark, corpus):
    docs = frame(spark, corpus)
    counts = {(r.doc_id, r.source): r.tokens for r in rollup.count_tokens(docs).where("doc_id is not null").collect()}
    assert counts == {(i, f"s{i % 2}"): len(w) - 1 for (i, t), w in zip(corpus, whole([t for _, t in corpus])) if i is not None}
    store = Scratch(spark, "store").path("s")
    schema = "kind string, source string, lang string, version string, tokens long, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert rollup.totals(spark, store).count() == 0
    first = batch(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "de", "v1", 7, None))
    assert rollup.commit(spark, store, "b1", first) and not rollup.commit(spark, store, "b1", batch(("insert", "a", "en", "v1", 99, None)))
    assert rollup.Store(spark, store).names("commits") == ["b1"] and len(rollup.Store(spark, store).names("data")) == 1
    assert rollup.commit(spark, store, "b2", batch(("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 12, 10), ("delete", None, "de", "v1", 7, None)))
    assert rollup.commit(spark, store, "b3", batch().limit(0))
    assert [tuple(r) for r in rollup.totals(spark, store).collect()] == [("a", "en", "v1", 1, 12)]
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit(spark, store, "b4", batch(("upsert", "a", "en", "v1", 1, None)))
    with pytest.raises(ValueError):
        rollup.commit(spark, store, "../b", first)
    assert [tuple(r) for r in rollup.totals(spark, store).collect()] == [("a", "en", "v1", 1, 12)]


def test_compacted_rollups(spark):
    store = Scratch(spark, "store").path("c")
    batch = lambda kind, n: spark.createDataFrame([(kind, "a", "en", "v1", n, None)], "kind string, source string, lang string, version string, tokens long, old_tokens long")
    now = lambda: [tuple(r) for r in rollup.totals(spark, store).collect()]
    assert not rollup.compact(spark, store)
    rollup.commit(spark, store, "b1", batch("insert", 10))
    rollup.commit(spark, store, "b2", batch("insert", 5))
    assert rollup.compact(spark, store) and not rollup.compact(spark, store) and now() == [("a", "en", "v1", 2, 15)]
    assert not rollup.commit(spark, store, "b1", batch("insert", 10))
    assert rollup.commit(spark, store, "b3", batch("delete", 5)) and now() == [("a", "en", "v1", 1, 10)]
    assert rollup.compact(spark, store) and now() == [("a", "en", "v1", 1, 10)] and rollup.Store(spark, store).latest()[1] == []
    assert rollup.Store(spark, store).names("snapshots") == ["0", "1"] and not rollup.compact(spark, store)


def test_rollup_commits_once(spark, monkeypatch):
    store = Scratch(spark, "store").path("r")
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None)], "kind string, source string, lang string, version string, tokens long, old_tokens long")
    publish = rollup.Store.publish

    def slow(self, name, line):  # another writer commits the batch while this one has its data ready
        monkeypatch.setattr(rollup.Store, "publish", publish)
        assert rollup.commit(spark, store, "b1", batch(10))
        return publish(self, name, line)

    monkeypatch.setattr(rollup.Store, "publish", slow)
    assert not rollup.commit(spark, store, "b1", batch(99))
    assert [tuple(r) for r in rollup.totals(spark, store).collect()] == [("a", "en", "v1", 1, 10)]
    assert len(rollup.Store(spark, store).names("data")) == 1


def test_revisions_move_documents(spark):
    changes = spark.createDataFrame([("revise", "a", "en", "v1", 12, 10, "b", None, "v1"), ("revise", "a", "en", "v1", 3, 1, "a", "en", "v1"), ("insert", "c", "en", "v1", 5, None, "x", "x", "x")], "kind string, source string, lang string, version string, tokens long, old_tokens long, old_source string, old_lang string, old_version string")
    assert {tuple(r) for r in rollup.deltas(changes).collect()} == {("a", "en", "v1", 1, 14), ("b", None, "v1", -1, -10), ("c", "en", "v1", 1, 5)}
    assert rollup.deltas(changes.limit(0)).count() == 0


def test_rollup_query(spark, corpus, tmp_path):
    rows = [(i, t, [None, "en", "de"][k % 3], ["a", None][k % 2], 0) for k, (i, t) in enumerate(corpus)]
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.op4_token_rollups(spark, tables(spark, tmp_path, documents=spark.createDataFrame(rows, DOCS))).collect()}
    want = defaultdict(lambda: [0, 0])
    for (i, t, lang, source, _), ids in zip(rows, whole([r[1] for r in rows])):
        for version, n in (("byte_bpe_50k", len(ids) - 1), ("characters", len(t or ""))):
            if version == "byte_bpe_50k" or lang is not None:
                want[source, lang, version][0] += 1
                want[source, lang, version][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}


# ---------------------------------------------------------------- 5


def shingle_strings(text):
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: " " for c in "\t\n\x0b\x0c\r"})
    w = [x for x in (text or "").translate(table).split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_shingles(corpus):
    for (_, t), h in zip(corpus, shingles.shingle_sets([t for _, t in corpus])):
        assert len(h) == len(shingle_strings(t))


def test_structured_words_hash_apart():
    for n in (4, 7, 9):
        a = "a"
        for _ in range(n):
            a += a.translate(str.maketrans("ab", "ba"))
        b = a.translate(str.maketrans("ab", "ba"))
        (x,), (y,) = shingles.word_hashes([a, b])
        assert x != y
    seen = {int(h) for h in shingles.word_hashes([" ".join(["a" * n for n in range(1, 300)] + ["\0" * n for n in range(1, 300)])])[0]}
    assert len(seen) == 598


def test_few_strangers_share_a_key():
    rng = np.random.default_rng(8)
    for n in (4, 5, 16, 64, 65, 256, 1024):
        met = Counter()
        for _ in range(400):
            h = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            met.update({k for own in jaccard.signatures(h, np.zeros(0, np.uint64)) for k in own.tolist()})
        assert max(met.values()) <= 4, n


def test_jaccard_components(spark, corpus, monkeypatch):
    # keys count as hot, buckets are dealt into blocks; the pipeline's test goes the usual way
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "SAMPLED", 1)
    monkeypatch.setattr(jaccard, "blocked", lambda *a: common.blocked(*a, block=3))
    corpus = [*corpus, (-(1 << 63), corpus[60][1] + " end")]
    known = [(i, t) for i, t in corpus if i is not None]
    sets = {i: shingle_strings(t) for i, t in known}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = min(label[i], label[j])
    rows = jaccard.jaccard_components(clash(frame(spark, corpus), "n", "keys", "component_id")).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i: r.component_id for i, r in got.items()} == label and {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(label.values())) < len(label) - 5
    assert len(rows) == len(corpus)
    assert jaccard.jaccard_components(frame(spark, corpus).limit(0)).count() == 0


def test_jaccard_repeated_ids_keep_all_their_texts(spark):
    rng = random.Random(14)
    a, b, c, d = (words(rng, 60, 4000) for _ in range(4))
    rows = [(2, a), (5, a), (5, b), (9, b + " z"), (11, c), (12, d), (13, c), (13, d), (20, words(rng, 60, 4000))]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {(2, 2), (5, 2), (9, 2), (11, 11), (12, 11), (13, 11), (20, 20)}


def test_signatures_meet():
    rng = np.random.default_rng(6)
    for n in (1, 2, 4, 5, 16, 17, 40, 64, 65, 300, 1500):
        for _ in range(15):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            k = int(rng.integers(0, len(a) // 9 + 1))
            b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 9 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                for frequent in (np.zeros(0, np.uint64), np.sort(a[:: 2])):
                    x, y = (set(np.concatenate(jaccard.signatures(s, frequent)).tolist()) for s in (a, b))
                    assert x & y
                far = np.bitwise_count(jaccard.dense_sketch(a).view(np.uint64) ^ jaccard.dense_sketch(b).view(np.uint64)).sum()
                assert far <= len(a) + len(b) - 2 * both


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)] + [(5, None), (7, 7)]
    label = list(range(200))
    for _ in range(200):
        for u, v in edges:
            if v is not None:
                label[u] = label[v] = min(label[u], label[v])
    got = components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc"))
    rows = {r.node: r.component for r in got.collect()}
    assert got.count() == len(rows) and rows == {u: label[u] for e in edges if e[1] is not None and e[0] != e[1] for u in e}


# ---------------------------------------------------------------- 6


def test_language_id(spark):
    rng = random.Random(9)
    roots = {"xx": ["thea", "ing", "whe"], "yy": ["sch", "ung", "ein"], "zz": ["ción", "que", "ll"]}
    texts = [(i, " ".join("".join(rng.choice(roots[k]) for _ in range(3)) for _ in range(rng.randint(2, 40))), k) for i in range(200) for k in [rng.choice(list(roots))]]
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "123 !? ²", None), (903, "schung einein " * 120_000, "yy"), (None, "theaing whe", "xx"), (904, "ª", None)]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)})
    model = langid.train(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    held = [(i, k) for i, _, k in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([got[i].lang_pred == k for i, k in held]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "yy" and got[None].lang_pred == "xx" and got[904].lang_pred != "und"
    assert {r.doc_id for r in docs.where(langid.held_out()).collect()} & {i for i, _ in held} == {i for i, _ in held}
    assert langid.predict(docs.limit(0), model).count() == 0
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs.limit(5), none).collect()} == {"und"}


def test_training_counts(spark):
    rng = random.Random(19)
    rows = [(i, " ".join(rng.choice(["thea", "Ing", "É", "12", "漢"]) for _ in range(rng.randint(0, 9))), rng.choice(["xx", "yy", None])) for i in range(120)] + [(7, None, "xx"), (None, "thea", "yy"), (None, "thea", "yy")]
    langs, table = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), buckets=512)
    grams, texts = np.zeros((512, 2)), np.zeros(2)
    for _, t, lang in rows:
        if lang and t and any(map(str.isalpha, t)):
            texts[langs.index(lang)] += 1
            for _, b in langid.gram_buckets(langid.coded(t), 512):
                np.add.at(grams[:, langs.index(lang)], b, 1)
    assert langs == ["xx", "yy"] and np.allclose(table[:-1], np.log(grams + 0.5) - np.log(grams.sum(axis=0) + 256))
    assert np.allclose(table[-1], np.log(texts + 1) - np.log(texts.sum() + 2))
    with pytest.raises(ValueError, match="cells"):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), cells=5)
    few = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40, buckets=512)
    assert few[0] == ["xx", "yy"]


def test_language_query(spark, tmp_path):
    rng = random.Random(23)
    rows = [(i, words(rng, 20) if i % 2 else "der und die das " + words(rng, 9), "en" if i % 2 else "de", "s", 0) for i in range(60)] + [(70, None, "en", "s", 0), (71, "1 2", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in langid.op6_language_id(spark, tables(spark, tmp_path, documents=docs)).collect()}
    want = {r.doc_id: r for r in langid.predict(docs, langid.train(docs.where(~langid.held_out()))).collect()}
    for i, t, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i].lang_pred, got[i].score) == (want[i].lang_pred, want[i].score)
    assert got[70].lang_pred == got[71].lang_pred == "und"


def test_every_language_of_the_sample_is_learned(spark):
    rng = random.Random(10)
    roots = {"xx": ["thea", "ing", "whe"], "yy": ["sch", "ung", "ein"], "zz": ["ción", "que", "ll"]}
    rows = [(i, " ".join("".join(rng.choice(roots[k]) for _ in range(3)) for _ in range(rng.randint(2, 40))), k) for i in range(90) for k in [rng.choice(list(roots))]]
    rows += [(900, None, "xx"), (901, "12", "ww"), (902, "schung einein " * 120_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    of = lambda most: {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.train(docs, languages=most)).collect()}
    few, all_ = of(2), of(9)
    many = spark.createDataFrame([(i, f"wort{i} " * 5, f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    assert len(langid.train(many)[0]) == 300
    assert {p for p, _ in few.values()} == {"xx", "yy", "zz", "und"}
    assert all(few[i][0] == all_[i][0] and abs(few[i][1] - all_[i][1]) < 1e-3 for i in all_)


def test_language_sums_are_exact():
    rng = np.random.default_rng(3)
    table = rng.normal(size=(1 << 10, 2))
    texts = ["abc", "a", "", "é漢字 xyz" * 30] + ["ab cd ef" * (langid.BLOCK // 5)]
    got = langid.text_sums(texts, table)
    for t, row in zip(texts, got):
        want = sum(table[b].sum(axis=0) for _, b in langid.gram_buckets(langid.coded(t), len(table)))
        assert np.allclose(row, want)


# ---------------------------------------------------------------- 7


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows, centre = [], rng.normal(size=(6, 16))
    for i in range(300):
        rows.append((i, (centre[i % 6] + rng.normal(size=16) * (0.05 if i % 3 else 3)).tolist()))
    rows += [(400, rows[1][1]), (401, [2 * x for x in rows[1][1]]), (402, None), (403, []), (404, [0.0] * 16), (405, [float("nan")] + [1.0] * 15), (406, [None] + [1.0] * 15), (407, [1.0, 2.0]), (None, [1.0] * 16), (408, [float("inf")] * 16)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=16).collect()}
    assert len(got) == len(rows)
    ok = [i for i, e in rows if i is not None and (i < 402)]
    x = np.array([np.array(e, np.float32) for i, e in rows if i in ok and i is not None], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    n = link.sum(axis=1) - 1
    label = np.array(ok)
    for _ in range(10):
        label = np.array([label[link[k]].min() for k in range(len(ok))])
    found = np.array([got[i].n_links for i in ok])
    assert (found <= n).all() and found.sum() >= 0.95 * n.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(ok, label)]) > 0.97
    for i in (402, 403, 404, 405, 406, 407, 408, None):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert all(got[i].kept == (got[i].component_id == i) for i in ok)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    double = embeddings.near_vectors(clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "links", "key", "id"), block=16)
    assert {r.vec_id: r.component_id for r in double.collect()} == {i: r.component_id for i, r in got.items()}


def test_repeated_vectors_and_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 2.0]), (9, [1.0, 0.01])]
    got = Counter((r.vec_id, r.n_links) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == {(5, 2): 3, (7, 1): 1, (9, 1): 1}  # an id has the links of all its vectors


# ---------------------------------------------------------------- 8


def test_decontamination(spark):
    rng = random.Random(12)
    items = [(i, words(rng, n)) for i, n in enumerate([30, 12, 10, 3, 1, 0])] + [(10, None), (None, words(rng, 11)), (2, words(rng, 10)), (20, "ÉTÉ Über 3x")]
    texts = []
    for d in range(60):
        w = words(rng, rng.randint(0, 60)).split()
        if d % 2:
            own = rng.choice([t for _, t in items if t]).split()
            a = rng.randint(0, max(0, len(own) - 10))
            w[5:5] = [x.upper() for x in own[a : a + rng.randint(9, 14)]]
        texts.append((d, rng.choice(["; ", " ", "\n--"]).join(w)))
    texts += [(70, None), (71, ""), (72, "!?"), (73, words(rng, 9) + " été-über 3X " * 3)]
    windows = defaultdict(set)
    norm = lambda t: decontam.normal_words(t)
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])] |= set() if i is None else {str(i)}
    texts.append((74, " ".join([words(rng, 20_000), items[0][1], words(rng, 20_000)])))
    for size in (decontam.ITEM_BYTES, 100):  # one automaton, and several
        docs = clash(frame(spark, texts), "n_words", "spans", "runs", "item_id")
        found = decontam.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), item_bytes=size)
        got = {r.doc_id: r for r in found.collect()}
        for d, t in texts:
            w, hit, ids = norm(t), set(), set()
            for n in {len(g) for g in windows}:
                for k in range(len(w) - n + 1):
                    if (own := windows.get(tuple(w[k : k + n]))) is not None:
                        hit |= set(range(k, k + n))
                        ids |= own
            assert (got[d].n_words, got[d].n_hit, got[d]["items"], got[d].contaminated) == (len(w), len(hit), sorted(ids), bool(hit)), d
            assert sum(len(norm(t[s.start : s.end])) for s in got[d].spans) == len(hit)
    assert sum(bool(r.n_hit) for r in got.values()) > 5
    empty = decontam.find_contamination(frame(spark, texts), spark.createDataFrame([], "item_id long, text string"))
    assert empty.where("contaminated").count() == 0 and empty.count() == len(texts)


# ---------------------------------------------------------------- 9


def test_packing(spark, corpus):
    rows = packing.pack(frame(spark, corpus), capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for (i, t), ids in zip(corpus, whole([t for _, t in corpus])):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        if i is None:
            continue
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0 and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        assert all(r.length == 64 for r in own[1:])
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_sequence) <= 1.1 * -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack(frame(spark, corpus).limit(0)).count() == 0
    clashing = packing.pack(clash(frame(spark, corpus), "rem", "task", "rank", "piece", "base", "full"), capacity=64).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in clashing) == Counter((r.doc_id, r.piece, r.length) for r in rows)


@pytest.mark.parametrize("kind", ["even", "large", "small", "few"])
def test_layout(kind):
    rng = np.random.default_rng(1)
    n = {"even": rng.integers(1, 1024, 20_000), "large": rng.integers(300, 600, 20_000), "small": rng.integers(1, 90, 20_000), "few": rng.integers(1, 1024, 7)}[kind]
    counts = dict(zip(*(x.tolist() for x in np.unique(n, return_counts=True))))
    rows, total = packing.plan_layout(counts)
    assert total <= 1.06 * -(-n.sum() // 1024) + 2
    used, next_rank = defaultdict(list), Counter()
    for length, rank, places, first, times, offset in rows.tolist():
        assert rank == next_rank[length]
        next_rank[length] += places * times
        for k in range(times):
            used[first + k] += [(offset + p * length, length) for p in range(places)]
    assert next_rank == Counter(counts) and len(used) == total
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


# ---------------------------------------------------------------- 10


def test_chats(spark):
    rng = random.Random(4)
    parts = ["<|im_end|>", "<|im_start|>", "assistant\n", "\n", "%3C|", "%25", "%", "<", "|", "<|esc|>", "hello", "é漢", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.randint(0, 3), rng.choice(["user", "assistant", "system", "a\nb<|esc|>", "%0A", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))])))
    rows += [(None, 1, "user", "x"), (70, None, "assistant", "y"), (70, None, "assistant", "y")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = {r.conv_id: r for r in chats.select("*", chat.parse("formatted").alias("turns")).select("*", chat.loss_text("turns").alias("loss")).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in own]
        assert got[c].loss == "".join(t for _, r, t in own if r == "assistant") and got[c].n_turns == len(own)
        # only what conflicts is escaped, and spans are of texts as rendered
        assert got[c].escaped == sum(any(m in t for m in ("<|im_start|>", "<|im_end|>", "<|esc|>")) for _, _, t in own)
        shown = [got[c].formatted[x.start : x.start + x.length] for x in got[c].loss_spans]
        assert [t if got[c].formatted[x.start - 8 : x.start - 1] != "<|esc|>" else t.replace("%3C|", "<|").replace("%25", "%") for x, t in zip(got[c].loss_spans, shown)] == [t for _, r, t in own if r == "assistant"]
    assert got[None].formatted == "<|im_start|>user\nx<|im_end|>\n" and any(r.escaped for r in got.values())
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_chats_take_linear_time(spark):
    def took(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <| "), "id").alias("text"))
        began = time.time()
        r = chat.format_chats(rows).select("n_turns", F.size(chat.parse("formatted")).alias("m"), F.size("loss_spans").alias("k")).first()
        assert r == (n, n, n // 2)
        return time.time() - began

    took(1000)
    assert took(40_000) < 6 * max(took(10_000), 1)


def test_chat_stays_native(spark):
    plan = chat.format_chats(spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hash_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
