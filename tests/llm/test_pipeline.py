"""The pipeline's stages against brute force, each on what the stage before it kept."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexaudit.llm import bpe, decontam, langid, lines
from tests.llm.test_ops import near, shingle_strings, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, words(rng, 25, 5000)) for i in range(4)]
    base, shared = words(rng, 100, 5000), words(rng, 12, 5000)
    texts = ["\n".join(words(rng, rng.randint(8, 40), 5000) for _ in range(rng.randint(1, 4))) for _ in range(50)]
    for _ in range(8):
        w = base.split(" ")
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(9999)}q"
        texts.append(" ".join(w))
    texts += [shared + "\n" + words(rng, 30, 5000) for _ in range(5)]
    texts += [words(rng, 10, 5000) + " " + " ".join(items[k][1].upper().split()[3:16]) for k in range(3)]
    texts += [None, "", "12 34 !", texts[0], texts[0] + "x", "\n".join(texts[1].split("\n")[::-1])]
    rows = [(i, t, "en" if i % 5 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return f"file://{path}", items


def smallest(ids, linked):
    label = {i: i for i in ids}
    for _ in ids:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and linked(i, j):
                    label[i], changed = label[j], True
        if not changed:
            return label
    return label


def test_stages(spark, tables):
    path, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    langs, table = langid.train(docs.where(~langid.held_out()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == COLUMNS, name
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert all(r.n_chars == len(r.text or "") for r in docs.collect())

    sure = {}
    for i, t in kept[0].items():
        if t and any(map(str.isalpha, t)):
            s = table[-1] + sum(table[b].sum(axis=0) for _, b in langid.gram_buckets(langid.coded(t)))
            p = np.exp(s - s.max())
            if p.max() / p.sum() >= 0.5:
                sure[i] = t
    assert set(kept[1]) == set(sure) and len(sure) == len(kept[0]) - 3

    all_lines = [((i, k), x) for i, t in kept[1].items() for k, x in enumerate(t.split("\n"))]
    text = dict(all_lines)
    label = smallest(sorted(text), lambda m, n: (text[m] == text[n] and text[m].strip(" \t\r\f\x0b")) or (min(len(text[m]), len(text[n])) >= lines.MIN_NEAR and abs(len(text[m]) - len(text[n])) <= 2 and near(text[m], text[n], 2)))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if label[i, k] == (i, k)) for i, t in kept[1].items()}
    assert kept[2] == {i: t for i, t in want.items() if t}
    assert len(kept[2]) < len(kept[1])

    sets = {i: shingle_strings(t) for i, t in kept[2].items()}
    label = smallest(sorted(sets), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert set(kept[3]) == {i for i in sets if label[i] == i} and len(kept[3]) < len(kept[2])

    windows = {tuple(w[k : k + 10]) for _, t in items for w in [decontam.normal_words(t)] for k in range(len(w) - 9)}
    dirty = {i for i, t in kept[3].items() for w in [decontam.normal_words(t)] if any(tuple(w[k : k + 10]) in windows for k in range(len(w)))}
    assert set(kept[4]) == set(kept[3]) - dirty and len(dirty) == 3

    rows, ids = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect(), {}
    plain = Tokenizer.from_file(bpe.default_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(int)
    for i, t in kept[4].items():
        ids[i] = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(ids) and all(sum(r.length for r in own) == len(ids[i]) for i, own in by_doc.items())
    assert max(by_sequence.values()) <= 1024 and len(by_sequence) <= 1 + 1.1 * -(-sum(map(len, ids.values())) // 1024)


def test_run_gives_the_last_stage(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert "sequence_id" in got.columns and got.count() > 0


def test_odd_and_repeated_rows(spark, tables, tmp_path):
    path, items = tables
    text = words(random.Random(3), 40, 5000)
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), *[(11, text, "en", "s", len(text))] * 3, (13, "ein Satz.", "de", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in (11, 13))  # training reads them
    assert sorted(r.doc_id for r in got) == [11, 11, 11, 13]  # repeated rows are one document to the stages, and stay
