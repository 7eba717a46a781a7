"""The token layer's plan and its runs, and places of findings that share a text."""

from pyspark.sql import functions as F

from lexaudit.operators import detectors as D
from lexaudit.operators import report as P
from lexaudit.operators import tokens as K


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_tokens_without_sort_and_with_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "Audit audit. The Audit"), (2, None), (3, "x")], "doc_id long, text string")
    toks = K.tokens(K.plain(docs))
    assert "Window" not in plan(toks) and "Sort" not in plan(toks)
    executed = K.vocabulary(toks)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1
    assert "Window" not in plan(K.bigrams(toks))


def test_runs_of_texts(spark, monkeypatch):
    texts = ["", "Ab cd", "", "é\U0001d400b-c. Ω\n\nx", "| a | b |\nc d", "a b\n# References\nc d", "\n", "_ - __"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, K.tokens(K.plain(docs)).collect()), key=str)
    monkeypatch.setattr(K, "RUN_CHARS", 1)  # each text alone
    assert sorted(map(tuple, K.tokens(K.plain(docs)).collect()), key=str) == want
    by = {(r.doc_id, r.text): r for r in K.tokens(K.plain(docs)).collect()}
    assert (by[1, "Ab"].then, by[1, "cd"].then) == ("cd", None)
    assert (by[3, "Ω"].boundary, by[3, "x"].boundary, by[3, "é\U0001d400b-c"].end) == (True, True, 5)
    assert not by[4, "a"].usable and by[4, "c"].usable and by[5, "a"].usable and not by[5, "c"].usable and by[5, "c"].then is None


def test_contexts_are_cut_from_one_copy_of_a_text(spark):
    text = ("Intro words. " + "We saw the Dashboard and a dashboard here. " * 30) + "É  end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = P.with_contexts(D.findings(docs, checks={"case"}), docs)
    got = {r.key: r for r in items.collect()}["dashboard"]
    first = text.index("Dashboard")
    assert got.contexts[0] == text[:first + 9 + 45].strip(" ") + "…" and got.total == 60 and got.more == 57
    # findings meet the text by document, after they are gathered
    assert "collect_list" in plan(items.select(F.col("doc_id"), "contexts"))


def test_spellings_are_counted_once(spark):
    """Detectors read counts of spellings: places among all tokens and among the usable ones are kept apart."""
    rows = [("Abc", 0, False, True), ("Abc", 5, True, False), ("abc", 9, True, False), ("abc", 12, False, False), ("ABC", 20, False, False)]
    toks = spark.createDataFrame([(1, t, t.lower(), s, u, b) for t, s, u, b in rows], "doc_id long, text string, lower string, start int, usable boolean, boundary boolean")
    forms = K.forms(toks)
    assert K.forms(forms) is forms
    assert {tuple(r) for r in forms.collect()} == {(1, "Abc", "abc", 2, 1, 1, 0, 5), (1, "abc", "abc", 2, 1, 1, 9, 9), (1, "ABC", "abc", 1, 0, 0, 20, None)}
    assert [tuple(r) for r in K.vocabulary(forms).collect()] == [(1, "abc", 5, 2, 0)]
    for x in (toks, forms):
        assert {(r.form, r.n, r.first_start) for r in D.case(x).collect()} == {("Abc", 1, 5), ("abc", 1, 9)}
    grams = spark.createDataFrame([(1, "a", "b", 3), (1, "a", "b", 1), (1, "A", "b", 7)], "doc_id long, w1 string, w2 string, start int")
    assert {tuple(r) for r in K.pairs(grams).collect()} == {(1, "a", "b", 2, 1), (1, "A", "b", 1, 7)}
    assert {(r.form, r.n, r.first_start) for r in D.phrase(K.pairs(grams)).collect()} == {("a b", 2, 1), ("A b", 1, 7)}
