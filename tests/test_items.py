"""Reports by one pass of each text: without a shuffle, and the same as by words dealt out by document."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexaudit.functions import text as T
from lexaudit.operators import detectors as D
from lexaudit.operators import items as I
from lexaudit.operators import report as P
from lexaudit.operators import tokens as K
from lexaudit.plans import sql as Q

DATA = "/root/testdata/sf0.001"
PIECES = "email e-mail E-mail e_mail Website website WEBSITE web site userId user_id UserID colour color colours organise organize ledgers ledgerz consistant consistent Review Board review board Board Review (CAR) NLP NLP NLP log in Capital Adequacy Ratio (CAR) Council Register ΑΣ ας İz ſetup set up set-up Ᲊb ᲊb é \U0001d400x data set data set 9 _ -- . \n \n\n | | ** # References \n".split(" ")


@pytest.mark.parametrize("name", ["markdown_report", "html_report"])
def test_reports_without_a_shuffle(spark, name):
    executed = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in executed for x in ("Exchange", "InMemoryTableScan", "Join", "Sort"))


def test_same_as_findings(spark):
    rng = random.Random(11)
    texts = [None, "", *Q.FIXTURES, *(" ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 120))) for _ in range(60))]
    docs = spark.createDataFrame([*enumerate(texts), (None, "Send an e-mail, an email.")], "doc_id long, text string").coalesce(1).persist()
    pairs = T.glossary_pairs(["website, web site, web site", "site, Web Site", "dataset, data set"])
    options = {"check_undefined": True, "sensitivity": 2, "glossary_pairs": pairs}
    items = P.with_contexts(D.findings(docs, **options), docs).persist()
    assert items.select("category").distinct().count() == len(I.CATEGORIES)
    for one, other in ((P.markdown(items, docs), P.markdown_of_texts(docs, **options)), (P.html(items, docs, "today"), P.html_of_texts(docs, "today", **options))):
        want, got = ({r.doc_id: r.report for r in x.collect()} for x in (one, other))
        assert got == want


def test_runs_of_findings(monkeypatch, spark):
    texts = ["", "Ab e-mail", "", *Q.FIXTURES, "email e-mail"]
    marks = [I.line_flags(t.split("\n")) for t in texts]
    table = np.frombuffer(I.zlib.decompress(K._classes(spark)), np.uint8)
    rules = I.Rules((), tuple(T.glossary_pairs()), True, 1)

    def found():
        every = [x for some, toks in K.runs(texts, np.array([len(m) for m in marks]), np.concatenate(marks), table) for x in rules.findings(some, toks)]
        return [[sorted((key, [v[1:] for v in sorted(forms)], shown, n) for key, forms, shown, n in found) for found in x] for x in every]

    want = found()
    monkeypatch.setattr(K, "RUN_CHARS", 1)  # each text alone
    assert found() == want and sum(map(len, want[-1])) == 2


def test_line_flags(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice(["**", "*", "# ", "works cited", "References", "REFERENCES", "Results", " and ", "discussion", "Table ", "Fig. 3", "1.", "|", " ", " ", " ", "\r", "A", "AB", "C D", "é", ":", "x" * 101]) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    got = spark.createDataFrame([("\n".join(lines),)], "text string").select(K.line_flags().alias("f")).first().f
    assert got == I.line_flags(lines) and set(got) == {0, 1, 2, 3}, [(x, a, b) for x, a, b in zip(lines, got, I.line_flags(lines)) if a != b][:5]


def test_near_words_pass_the_bound():
    rules, rng = I.Rules((), (), False, 1), random.Random(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in "ab")
        row = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                row[i][j] = min(row[i - 1][j] + 1, row[i][j - 1] + 1, row[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert rules.distance((a, b)) == row[-1][-1]
        x, y = (rules.low(f"ab{w}cdefg")[2][1] for w in (a, b))
        assert max((x & ~y).bit_count(), (y & ~x).bit_count()) <= row[-1][-1]


def test_lower_case_is_sparks(spark):
    rules = I.Rules(I._lowers(spark), (), False, 1)
    words = ["ΑΣ", "ΑΣ ΣΑ Σ", "İI", "ᲉB", "\U00010d50x", "ẞ", "K"]
    assert [rules.lower(w) for w in words] == [r.x for r in spark.createDataFrame(list(enumerate(words)), "k int, w string").select("k", F.lower("w").alias("x")).orderBy("k").collect()]
