"""The editorial audit on a hand-made manuscript, Word files and metadata."""

import io
import time
import zipfile

import pytest
from pyspark.errors import PySparkException

from lexaudit.operators.audit import labels as L
from lexaudit.operators.audit import metadata as M
from lexaudit.operators.audit import records as R
from lexaudit.operators.audit import references as C
from lexaudit.operators.audit import report as P
from lexaudit.operators.audit import rules as U
from lexaudit.sources import docx
from lexaudit.sources.docx_comments import annotate_docx

SCHEMA = "doc_id long, rec_no int, id string, text string, part string, kind string, style string, highlighted boolean"
LINES = [
    ("A Study of Audit Quality", "front", 5), ("Abstract: This study examines audit quality.", "abstract", 6), ("Keywords: audit, quality", "keywords", 3), ("1. Introduction", "introduction", 2), ("Table 1 shows the sample (Smith, 2020).", "introduction", 7),
    ("Table 1 Sample", "introduction", 3), ("Table 3 Results", "introduction", 3), ("[INSERT TITLE] goes here", "introduction", 4), ("Received: ; Accepted:", "introduction", 2), ("Highlighted line.", "introduction", 2), ("References", "references", 1),
    ("Smith, J. (2020). Audit quality. Journal A, 5(2), 1-20.", "references", 9), ("https://doi.org/10.1000/abc", "references", 1), ("Smith, J. (2020). Audit quality. Journal A, 5(2), 1-20. https://doi.org/10.1000/abc", "references", 10), ("Appendix A", "other", 2), ("Extra material.", "other", 2),
    ("A note with five words.", "footnote", 5), ("Running head", "header", 2),
]


def here(spark, df):
    """A small table without its lineage, so that it is computed once."""
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def records(spark):
    kinds, parts = {7: "table", 17: "footnote", 18: "header"}, {17: "word/footnotes.xml", 18: "word/header1.xml"}
    rows = [(1, i, f"P{i:04d}", t, parts.get(i, R.MAIN), kinds.get(i, "body"), None, i == 10) for i, (t, _, _) in enumerate(LINES, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_zones_and_words(spark, records):
    z = R.zones(records).withColumn("w", R.words(R.F.col("text"))).orderBy("rec_no").collect()
    assert [(r.section, r.w) for r in z] == [(s, n) for _, s, n in LINES]
    assert {r.id for r in z if not r.in_article} == {"P0009", "P0012", "P0013", "P0014", "P0018"}
    assert R.document_words(records).first()[1:] == (62, 5, 67) and R.document_words(records, False).first().total == 62
    a = R.abstracts(R.zones(records)).first()
    assert (a.abstract, a.words, a.bounded) == ("This study examines audit quality", 5, True)


def test_word_counts(spark):
    cases = {"2019–2020": 1, "well–known": 2, "a­b": 1, "漢字 test": 3, "https://x.org/a-b": 1, "— !": 0, "don't 3.14": 2}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r[0]: r[1] for r in df.select("t", R.words(df.t)).collect()}
    assert got == cases | {None: 0}


def test_overrides(spark, records):
    over = spark.createDataFrame([(1, None, "P0005", "P0006")], "doc_id long, reference_start string, abstract_start string, abstract_end string")
    z = R.zones(records, over)
    assert {r.id for r in z.where("in_abstract").collect()} == {"P0005", "P0006"}
    with pytest.raises(PySparkException):
        R.zones(records, spark.createDataFrame([(1, None, "P0005", "P0004")], over.schema)).collect()


def test_numeric_ranges(spark):
    cases = {"See [1-5000].": [("1", "5000", 5000)], "See [7, 3–4].": [("3", "4", 2), ("7", "7", 1)], "See [9-2].": [("9", "2", 2)], "See [12345678901] and [007].": [("12345678901", "12345678901", 1), ("7", "7", 1)], "See [1-999999999999999999].": [("1", "9" * 18, 10**18 - 1)], "See [1-" + "9" * 60 + "].": [("1", "9" * 60, 2)]}
    zoned = R.zones(spark.createDataFrame([(1, i, f"P{i}", t, R.MAIN, "body", None, False) for i, t in enumerate(cases)], SCHEMA))
    got = {i: [] for i in range(len(cases))}
    for r in C.citations(zoned).collect():
        got[r.rec_no].append((r.number, r.last, r.n))
    assert [sorted(x) for x in got.values()] == list(cases.values())
    assert U.audit(zoned.select(*R.zones(zoned).columns[:8])).where("id = 'numeric-style'").count() == 1


def test_long_caption_numbers(spark):
    texts = ["Table 1 One", "Table 0002 Two", "Table " + "9" * 60 + " Many", "See Table 1, Table 2 and Table " + "9" * 60 + "."]
    zoned = R.zones(spark.createDataFrame([(1, i, f"P{i}", t, R.MAIN, "body", None, False) for i, t in enumerate(texts)], SCHEMA))
    assert [r.number for r in U.captions(zoned).orderBy("rec_no").collect()] == ["1", "2", "9" * 60]
    got = {r.id: r.args for r in U.caption_rules(zoned).collect()}
    assert set(got) == {"caption-sequence-Table"} and got["caption-sequence-Table"][1] == "1, 2, " + "9" * 60


def test_citations_find_their_references(spark):
    texts = ["World Health Office (WHO, 2019) and WHO (2019) say so.", "Lee and Kim (2020), Lee et al. (2020), Lee (2020) and Roe (2018).", "Ann and Bob, 2001; Ann & Bob (2001) and Cid et al (2002) (Dan 2003).", "References",
             "World Health Office. (2019). Health. Press.", "Lee, A., & Kim, B. (2020). One. Journal, 1(1), 2-3.", "Lee, A., Kim, B., & Poe, C. (2020). Two. Journal, 1(1), 4-5.", "Roe, A., & Doe, B. (2018). Three. Journal, 1(1), 6-7."]
    zoned = R.zones(spark.createDataFrame([(1, i, f"P{i}", t, R.MAIN, "body", None, False) for i, t in enumerate(texts, 1)], SCHEMA))
    parsed = C.parse(C.entries(zoned))
    got = {(r.raw, r.status, r.ref_id) for r in C.resolve(C.citations(zoned), parsed, C.acronyms(zoned)).collect() if r.rec_no < 3}
    assert got == {("WHO, 2019", "matched", "R1"), ("WHO (2019)", "matched", "R1"), ("Lee and Kim (2020)", "matched", "R2"), ("Lee et al. (2020)", "matched", "R3"), ("Lee (2020)", "ambiguous", None), ("Roe (2018)", "review", None)}
    assert {(r.code, r.correction) for r in C.forms(zoned).collect()} >= {("Ann and Bob, 2001", "Ann & Bob, 2001"), ("Ann & Bob (2001)", "Ann and Bob (2001)"), ("Cid et al (2002", "Cid et al. (2002"), ("Dan 2003", "Dan, 2003")}


def test_issues(spark, records):
    images = spark.createDataFrame([(1, 0, "r1", True, None), (1, 1, "r2", False, 72.0), (1, 2, "r3", False, 150.0), (1, 3, "r4", False, None)], "doc_id long, img_no int, relationship_id string, missing boolean, dpi double")
    found = here(spark, U.audit(records, images))
    issues = {r.id: r for r in found.collect()}
    assert set(issues) == {"reference-minimum", "duplicates-0", "ambiguous-1", "caption-sequence-Table", "callout-Table-3", "placeholder-P0008", "blank-date-P0009", "highlight-P0010", "image-missing-0", "image-resolution-1"}
    assert issues["placeholder-P0008"].examples == ["[INSERT TITLE]"] and issues["highlight-P0010"].review
    assert {r.id for r in U.lengths(R.zones(records), U.Limits.of(abstract_max=4, manuscript_max="66")).collect()} == {"abstract-length", "manuscript-length"}
    with pytest.raises(ValueError):
        U.Limits.of(abstract_max=0.5)
    n = here(spark, P.numbered(found))
    assert [r.number for r in n.orderBy("number").collect()] == list(range(1, 11))
    plan = P.comments(n, records).orderBy("comment_id").collect()
    assert plan[0].paragraph_id == "P0001" and len(plan) == 8
    # numbers follow rules and places, not ids as text
    many = spark.createDataFrame([(1, k, f"P{k}", t, R.MAIN, "body", None, False) for k, t in enumerate(["References", *(f"Name{chr(97 + k)}, A. (2001). Work {k}. Journal, 1(1), {k}." for k in range(12))])], SCHEMA)
    order = [r.id for r in P.numbered(U.reference_rules(R.zones(many))).orderBy("number").collect()]
    assert order == ["reference-minimum", *(f"uncited-R{k}" for k in range(1, 13))]


def test_reports(spark, records):
    z = here(spark, R.zones(records))
    parsed = here(spark, C.parse(C.entries(z)))
    resolved = here(spark, C.resolve(C.citations(z), parsed, C.acronyms(z)))
    verified = M.verify(parsed, spark.createDataFrame([tuple((BASE | {"doi": "10.1000/abc", "volume": "6"}).values())], TABLE))
    verified = here(spark, verified)
    manual = U.validate_manual(spark.createDataFrame([(1, 1, 2, "Fine.", [("P0001", "Audit  Quality")])], MANUAL), records, parsed.select("doc_id", "doi"))
    auto = U.record_rules(z).unionByName(U.caption_rules(z))
    issues = here(spark, auto.unionByName(M.verification_issues(parsed, verified, records)).unionByName(U.manual_issues(manual)))
    items = here(spark, P.numbered(issues))
    assert [r.section for r in items.orderBy("number").collect()] == sorted(r.section for r in items.collect()) and {2, 4} <= {r.section for r in items.collect()}
    numbers = here(spark, P.summary(z, parsed, resolved, C.duplicates(parsed), verified, issues))
    n = numbers.first()
    assert (n.words, n.abstract_words, n.references, n.duplicates, n.verified, n.citations, n.excluded) == (67, 5, 2, 1, 0, 1, 0)
    told = parsed.select("doc_id", "ref_no", "id", "raw").join(verified.select("doc_id", "id", "status", "reason"), ["doc_id", "id"])
    who = spark.createDataFrame([(1, " M-1 ", True, 1234, ["own warning"])], "doc_id long, manuscript_id string, confirmed boolean, saved_words int, warnings array<string>")
    for lang, title, mode, verb in (("en", "Manuscript report", "Reviewed by the editor", "Correct the fields"), ("id", "Laporan naskah", "Ditinjau editor", "Perbaiki bidang itu")):
        rows = here(spark, P.report(who, numbers, items, told, z, lang))
        r = rows.first()
        assert (r.title, r.mode, r.language) == (title, mode, lang) and "M-1" in r.subject and r.warnings[-1] == "own warning" and len(r.summary) == 11
        assert [g.section for g in r.groups] == [2, 4, 7] and [x.number for g in r.groups for x in g["items"]] == list(range(1, items.count() + 1))
        assert [x.status for x in r.references] == [{"en": "Metadata mismatch", "id": "Metadata berbeda"}[lang]] * 2
        letter, page = P.letters(rows, lang).first().letter, P.html(rows, lang).first().html
        assert verb in letter and "Fine." in letter and "! own warning" in letter and page.count("<h2>") == 3 and verb in page
    with pytest.raises(PySparkException):
        P.report(who.withColumn("manuscript_id", R.F.lit(" ")), numbers, items, told, z).collect()
    assert P.short(L.displayed(items, "en")).count() == items.count()


def test_editor_override(spark, records):
    verified = M.verify(C.parse(C.entries(R.zones(records))), spark.createDataFrame([], TABLE))
    decided = spark.createDataFrame([(1, "R1", "editor_verified", "https://press.example/x", "seen there"), (1, "R2", "editor_verified", "http://press.example/x", "seen there")], "doc_id long, id string, new_status string, url string, why string")
    got = {r.id: (r.status, r.lookup, r.reason) for r in M.editor_override(verified, decided).collect()}
    assert got["R1"] == ("editor_verified", "editor", "seen there") and got["R2"][0] == "unverified"


def test_service_records(spark):
    one = '{"title": ["T"], "DOI": "10.1/A", "author": [{"family": "B", "given": "C"}], "issued": {"date-parts": [[2020, 1]]}, "published": {"date-parts": [[2021]]}, "container-title": ["J"], "type": "journal-article", "page": "1-2"}'
    r = M.biblio(spark.createDataFrame([(one,), ("{}",)], "json string")).collect()
    assert (r[0].doi, r[0].title, r[0].years, r[0].container, r[0].authors[0].family) == ("10.1/A", "T", ["2020", "2021"], "J", "B") and r[1].years == []


def test_references(spark, records):
    p = C.parse(C.entries(R.zones(records))).orderBy("ref_no").collect()
    assert [(r.id, r.record_ids, r.authors, r.year, r.title, r.journal, r.volume, r.issue, r.pages, r.doi) for r in p] == [("R1", ["P0012", "P0013"], ["Smith, J."], "2020", "Audit quality", "Journal A", "5", "2", "1-20", "10.1000/abc"), ("R2", ["P0014"], ["Smith, J."], "2020", "Audit quality", "Journal A", "5", "2", "1-20", "10.1000/abc")]


def test_manual_findings(spark, records):
    rows = [(2, "Fine.", [("P0001", "Audit  Quality")]), (9, "x", [("P0001", "A")]), (1, "x", []), (1, "x", [("P0001", "nope")]), (1, "see 10.1234/zz", [("P0001", "A")]), (1, "All references are verified", [("P0001", "A")])]
    items = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], MANUAL)
    dois = spark.createDataFrame([(1, "10.1000/abc")], "doc_id long, doi string")
    got = {(r.section, r.comment, len(r.evidence)): r.error for r in U.validate_manual(items, records, dois).collect()}
    assert got[2, "Fine.", 1] is None and sum(e is not None for e in got.values()) == len(got) - 1


MANUAL = "doc_id long, item int, section int, comment string, evidence array<struct<paragraph_id:string,quote:string>>"
BASE = dict(doi="10.1/X", title="Audit Quality.", authors=[("Smith", "John", None)], years=["2020"], container="Journal A", publisher=None, type="journal-article", volume="5", issue=None, page="1–20", article_number=None)
TABLE = "doi string, title string, authors array<struct<family:string,given:string,name:string>>, years array<string>, container string, publisher string, type string, volume string, issue string, page string, article_number string"


@pytest.mark.parametrize(("change", "status", "identity"), [({}, "metadata_verified", True), ({"authors": [("Smith", "Jörg", None)]}, "metadata_verified", True), ({"authors": [("Smith", "Ĵan", None)]}, "metadata_verified", True), ({"volume": "6"}, "metadata_mismatch", True), ({"title": "Other work"}, "metadata_mismatch", False), ({"volume": None}, "partial_match", True), ({"authors": [("Smith", "Karl", None)]}, "metadata_mismatch", False), ({"years": []}, "partial_match", False), ({"authors": [("Smith", None, None)]}, "partial_match", True)])
def test_metadata(spark, change, status, identity):
    ref = spark.createDataFrame([(1, 1, ["P1"], "R1", True, ["Smith, J."], "2020a", "Audit quality", "Journal A", None, "5", None, "1-20", None, "10.1/x", False, "raw")], "doc_id long, ref_no int, record_ids array<string>, id string, parsed boolean, authors array<string>, year string, title string, journal string, publisher string, volume string, issue string, pages string, article_number string, doi string, is_institutional boolean, raw string")
    told = M.verify(ref, spark.createDataFrame([tuple((BASE | change).values())], TABLE))
    r = told.first()
    assert (r.status, r.identity) == (status, identity)
    found = M.verification_issues(ref, told, spark.createDataFrame([(1, "P1", "text")], "doc_id long, id string, text string")).collect()
    assert {x.kind for x in found} == {"verification-doi-format"} | ({"verification-mismatch"} if status == "metadata_mismatch" else set())
    assert all(x.section == 4 and x.evidence[0].quote == "text" for x in found)


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def word_file(body, extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types></Types>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{body}</w:body></w:document>')
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


def run(text, props=""):
    return f"<w:r>{props}<w:t>{text}</w:t></w:r>"


BODY = (
    f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr>{run("One")}<w:r><w:tab/></w:r>{run("two")}</w:p><w:p>{run("  ")}</w:p>'
    f'<w:p>{run("seen")}<w:del>{run("gone")}</w:del>{run("hidden", "<w:rPr><w:vanish/></w:rPr>")}{run("shown", "<w:rPr><w:vanish w:val=" + chr(34) + "false" + chr(34) + "/></w:rPr>")}</w:p>'
    f'<w:tbl><w:tr><w:tc><w:p>{run("cell", "<w:rPr><w:highlight w:val=" + chr(34) + "yellow" + chr(34) + "/></w:rPr>")}</w:p></w:tc></w:tr></w:tbl>'
    f'<w:p>{run("outer")}<mc:AlternateContent><mc:Choice><w:txbxContent><w:p>{run("box")}</w:p></w:txbxContent></mc:Choice><mc:Fallback><w:p>{run("old")}</w:p></mc:Fallback></mc:AlternateContent></w:p>'
)


def test_docx(spark, tmp_path):
    header = f'<w:hdr xmlns:w="{W}"><w:p>{run("Head")}</w:p></w:hdr>'
    (tmp_path / "a.docx").write_bytes(word_file(BODY, {"word/header1.xml": header, "docProps/app.xml": "<P><Application>Microsoft Office Word</Application><Words>12</Words></P>"}))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = {r.path.rpartition("/")[2]: r for r in docx.read_docx(spark, str(tmp_path)).collect()}
    a = rows["a.docx"]
    assert [(r.id, r.text, r.kind, r.highlighted) for r in a.records] == [("P0001", "One\ttwo", "body", False), ("P0002", "seenshown", "body", False), ("P0003", "cell", "table", True), ("P0004", "outer", "body", False), ("P0005", "box", "textbox", False), ("P0006", "Head", "header", False)]
    assert (a.table_count, a.saved_words, a.is_word, a.records[0].style) == (1, 12, True, "Title") and a.warnings == ["tracked-changes:word/document.xml"]
    assert rows["b.docx"].error and not rows["b.docx"].records


def test_docx_refusals():
    assert docx.parse_docx("x.doc", b"")["error"]
    assert "entities" in docx.parse_docx("x.docx", word_file("").replace(b"x", b"x"))["error"] or docx.parse_docx("x.docx", word_file(""))["error"] == "no text to audit"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')
    assert docx.parse_docx("x.docx", out.getvalue())["error"] == "a part declares entities"


def test_image_sizes():
    assert docx.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")) == (640, 480)
    assert docx.image_size(b"GIF89a" + (30).to_bytes(2, "little") + (20).to_bytes(2, "little")) == (30, 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (50).to_bytes(2, "big") + (70).to_bytes(2, "big") + b"\0" * 8
    assert docx.image_size(jpeg) == (70, 50) and docx.image_size(b"") is None
    assert docx.resolve("word/document.xml", "../media/a.png") == "media/a.png" and docx.resolve("word/d.xml", "/x/y") == "x/y"


def test_comments_in_a_copy():
    data = word_file(BODY)
    made = annotate_docx("a.docx", data, [("P0002", "Check <this>.\nTwice.")])
    assert docx.parse_docx("a.docx", made)["records"] == docx.parse_docx("a.docx", data)["records"]
    assert b"Check &lt;this&gt;." in zipfile.ZipFile(io.BytesIO(made)).read("word/comments.xml")
    with pytest.raises(docx.Refused):
        annotate_docx("a.docx", data, [("P0999", "x")])


def test_long_lines_are_searched_for_what_matches_hold(spark):
    """Long lines are no headings but abstracts, and patterns run only where a match can be."""
    long = "Abstract: " + "word " * 60
    texts = [long, "Keywords " * 30, "1. Discussion", "Discussion" + " x" * 80, "Received: by hand " + "y " * 80, "TaBlE 2 Sample", "see FIG. 3", "a todo", "rEvIsEd:"]
    df = spark.createDataFrame([(1, k, f"P{k}", t, R.MAIN, "body", None, False) for k, t in enumerate(texts)], SCHEMA)
    z = R.zones(df).orderBy("rec_no").collect()
    assert [r.heading for r in z] == ["abstract", "keywords", "discussion", None, None, None, None, None, None]
    assert [r.in_article for r in z] == [True] * 4 + [False] + [True] * 3 + [False]
    assert {r[0] for r in U.record_rules(R.zones(df)).select("id").collect()} == {"placeholder-P7", "blank-date-P8"}
    assert {r.type for r in U.callouts(R.zones(df)).collect()} == {"Figure"} and [r.number for r in U.captions(R.zones(df)).collect()] == ["2"]


def test_words_are_counted_without_going_back(spark):
    """Runs of marks without a letter cost their length, not its square."""
    marks = spark.createDataFrame([("-" * 400_000 + " a",), ("…" * 400_000 + " a",)], "t string")
    began = time.time()
    assert [r[0] for r in marks.select(R.words(marks.t)).collect()] == [1, 1]
    assert time.time() - began < 60
