"""Reference entries, citations and their resolution.

The grammar of entries and citations is our own reading of APA 7:

* entry: authors (year). title. container, volume(issue), pages. doi. Authors are "Surname, I. I."
  joined by commas, `&` or `and`; a name without initials is an institution.
* citation in brackets: (Author, 2020; Author & Author, 2021a; Author et al., 2019); in running
  text: Author (2020), Author and Author (2020), Author et al. (2020).
* numeric citation: [1], [2, 5], [3-6]. A range is one row with its ends and how many it cites, so
  a long one costs no more than a short one. Numbers of more than DIGITS digits make no range.
* an institution may be cited by an acronym that the text defines: World Health Organization (WHO).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions.text import WS, trim
from .records import flat, norm

# fixed values: what continues an entry, and its number
CONTINUATION = rf"(?i)^(?:https?://|doi[{WS}]*:|\d+[{WS}]*\(\d+\)[{WS}]*,)"
HAS_YEAR = r"\((?:19|20)\d{2}\)"
ENTRY_NUMBER = rf"^[{WS}]*(?:\[\d+\]|\d+[.)])[{WS}]*"
YEAR = r"(?:19|20)\d{2}[a-z]?"
NAME = r"[\p{Lu}][\p{L}'’\-]+"
DOI = r"10\.\d{4,9}/[^\s“”\"<>]+"
GROUP = rf"\([^()]*{YEAR}[^()]*\)"
NARRATIVE = rf"({NAME}(?:(?: and | & ){NAME}| et al\.?)?) \(({YEAR})\)"
ACRONYM = rf"((?:{NAME}(?:[{WS}]+(?:of|and|for|the|on))*[{WS}]+){{1,6}}{NAME})[{WS}]*\(([A-Z]{{2,8}})[,)]"
#: Digits of the longest numbers that are counted with.
DIGITS = 18
NUMERIC = r"\[\d+(?:\s*[,–-]\s*\d+)*\]"


def entries(zoned: DataFrame) -> DataFrame:
    """doc_id, ref_no, id, raw, record_ids: reference records, with wrapped lines joined to the entry before."""
    r = zoned.where("in_references")
    order = W.partitionBy("doc_id").orderBy("rec_no")
    more = F.col("normal").rlike(CONTINUATION) & ~F.col("normal").rlike(HAS_YEAR)
    r = r.withColumn("starts", F.when((F.row_number().over(order) > 1) & more, 0).otherwise(1)).withColumn("ref_no", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("rec_no", "normal", "id")))
    return r.groupBy("doc_id", "ref_no").agg(rows.alias("rows")).select("doc_id", "ref_no", F.concat(F.lit("R"), "ref_no").alias("id"), F.array_join(F.transform("rows", lambda x: x.normal), " ").alias("raw"), F.transform("rows", lambda x: x.id).alias("record_ids"))


def _some(pattern: str, group: int, c: str = "line") -> Column:
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def parse(refs: DataFrame) -> DataFrame:
    """Entries with parsed, authors, year, title, journal, publisher, volume, issue, pages, article_number, doi and is_institutional."""
    r = refs.withColumn("line", F.regexp_replace("raw", ENTRY_NUMBER, ""))
    doi = F.regexp_replace(_some(rf"(?i)({DOI})", 1), r"[.,;)]*\z", "")
    head = rf"^(.+?)[{WS}]*\(({YEAR})[^)]*\)\.?[{WS}]*"
    r = r.withColumns({"doi": doi, "year": _some(head, 2), "names": _some(head, 1), "tail": F.regexp_replace(F.regexp_replace("line", head, ""), rf"(?i)[{WS}]*(?:https?://(?:dx\.)?doi\.org/|doi[{WS}]*:[{WS}]*)?{DOI}", "")})
    r = r.withColumn("tail", F.when(F.col("year").isNotNull(), F.col("tail")))
    r = r.withColumns({"title": _some(r"^(.+?[^.])(?:\.(?:\s|\z)|\z)", 1, "tail"), "rest": F.regexp_replace("tail", r"^(.+?[^.])(?:\.\s*|\z)", "")})
    personal = F.col("names").rlike(rf"^{NAME}(?: {NAME})*, \p{{Lu}}\.")
    people = F.transform(F.regexp_extract_all("names", F.lit(rf"({NAME}(?: {NAME})*,(?: ?\p{{Lu}}\.-?)+)"), F.lit(1)), trim)
    volume = rf"^(.+?),[{WS}]*(\d+)(?:\(([^)]+)\))?(?:,[{WS}]*([^.]+?))?\.?[{WS}]*\z"
    journal = F.col("rest").rlike(volume)
    place = F.when(journal, F.regexp_extract("rest", volume, 4))
    r = r.withColumns({
        "authors": F.when(F.col("names").isNull(), F.array().cast("array<string>")).when(personal, people).otherwise(F.array(F.regexp_replace(trim(F.col("names")), r"\.\z", ""))),
        "is_institutional": F.col("names").isNotNull() & ~personal,
        "journal": F.when(journal, F.regexp_extract("rest", volume, 1)),
        "publisher": F.when(~journal & (trim(F.col("rest")) != ""), F.regexp_replace(trim(F.col("rest")), r"\.\z", "")),
        "volume": F.when(journal, F.regexp_extract("rest", volume, 2)),
        "issue": F.when(journal & (F.regexp_extract("rest", volume, 3) != ""), F.regexp_extract("rest", volume, 3)),
        "pages": F.when(place.rlike(r"^[\p{L}]?\d+(?:[-–][\p{L}]?\d+)?\z"), place),
        "article_number": F.when((place != "") & ~place.rlike(r"^[\p{L}]?\d+(?:[-–][\p{L}]?\d+)?\z"), F.regexp_replace(place, r"(?i)^article ", "")),
    })
    return r.withColumn("parsed", F.col("title").isNotNull() & F.col("year").isNotNull()).drop("line", "names", "tail", "rest")


def identity(refs: DataFrame) -> Column:
    text = F.concat_ws(":", F.lit("text"), flat(F.array_join("authors", " ")), "year", flat(F.col("title")))
    return F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), F.lower("doi"))).when(F.col("parsed"), text).otherwise(F.concat(F.lit("raw:"), flat(F.col("raw"))))


def duplicates(parsed: DataFrame) -> DataFrame:
    """doc_id, group (from 0, by first entry), ids and extra (entries but one) of entries with one identity."""
    g = parsed.withColumn("identity", identity(parsed)).groupBy("doc_id", "identity").agg(F.sort_array(F.collect_list(F.struct("ref_no", "id"))).alias("m")).where(F.size("m") > 1)
    number = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("m")[0].ref_no)) - 1
    return g.select("doc_id", number.alias("group"), F.transform("m", lambda x: x.id).alias("ids"), (F.size("m") - 1).alias("extra"))


def _names(who: Column) -> tuple[Column, Column]:
    """First author and, of exactly two, the second."""
    first = trim(F.regexp_replace(who, rf"(?:[{WS}]*(?:&|,)|[{WS}]+and[{WS}]|[{WS}]+et[{WS}]+al).*\z", ""))
    second = F.regexp_extract(who, rf"^[^,&]*?[{WS}]*(?:&|[{WS}]and[{WS}])[{WS}]*([^,&]+?)[{WS}]*\z", 1)
    return first, F.when(second != "", second)


def digits(c: Column) -> Column:
    """A number as text, without leading zeros."""
    return F.regexp_replace(c, r"^0+(\d)", "$1")


def citations(zoned: DataFrame) -> DataFrame:
    """doc_id, rec_no, id, raw, parent_raw, author, second, year, et_al, number, last, n: one row a cited work or range of numbers, from article records.

    n is how many works a row cites: last - number + 1 for a range, 2 for one that runs backwards.
    """
    r = zoned.where("in_article").select("doc_id", "rec_no", "id", F.col("text").alias("t"))
    held = lambda x: r.where(F.contains("t", F.lit(x)))  # noqa: E731  what every match holds is looked for first
    group = held("(").select("doc_id", "rec_no", "id", F.explode(F.regexp_extract_all("t", F.lit(f"({GROUP})"), F.lit(1))).alias("parent_raw"))
    part = rf"^[^\p{{Lu}}]*(\p{{Lu}}[^,]*?),?[{WS}]+({YEAR})"
    group = group.select("*", F.explode(F.split(F.regexp_replace("parent_raw", r"^\(|\)\z", ""), ";")).alias("raw")).where(F.col("raw").rlike(part))
    group = group.select("doc_id", "rec_no", "id", trim(F.col("raw")).alias("raw"), "parent_raw", F.regexp_extract("raw", part, 1).alias("who"), F.regexp_extract("raw", part, 2).alias("year"))
    running = held(" (").select("doc_id", "rec_no", "id", F.explode(F.regexp_extract_all("t", F.lit(f"({NARRATIVE})"), F.lit(1))).alias("raw"))
    running = running.select("doc_id", "rec_no", "id", "raw", F.col("raw").alias("parent_raw"), F.regexp_extract("raw", NARRATIVE, 1).alias("who"), F.regexp_extract("raw", NARRATIVE, 2).alias("year"))
    first, second = _names(F.col("who"))
    none = F.lit(None).cast("string")
    both = group.unionByName(running).select("doc_id", "rec_no", "id", "raw", "parent_raw", first.alias("author"), second.alias("second"), "year", F.col("who").rlike(r"(?i)et\s+al").alias("et_al"), none.alias("number"), none.alias("last"), F.lit(1).cast("long").alias("n"))
    numeric = held("[").select("doc_id", "rec_no", "id", F.explode(F.regexp_extract_all("t", F.lit(f"({NUMERIC})"), F.lit(1))).alias("raw"))
    bounds = F.transform(F.regexp_extract_all("raw", F.lit(r"(\d+(?:\s*[–-]\s*\d+)?)"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)))
    numeric = numeric.select("doc_id", "rec_no", "id", "raw", F.explode(bounds).alias("b")).withColumns({"number": digits(F.col("b")[0]), "last": digits(F.element_at("b", -1))})
    small = (F.length("number") <= DIGITS) & (F.length("last") <= DIGITS)
    span = F.col("last").try_cast("long") - F.col("number").try_cast("long")
    n = F.when(small & (span >= 0), span + 1).otherwise(F.size("b").cast("long"))
    numeric = numeric.select("doc_id", "rec_no", "id", "raw", F.col("raw").alias("parent_raw"), none.alias("author"), none.alias("second"), none.alias("year"), F.lit(False).alias("et_al"), "number", "last", n.alias("n"))
    return both.unionByName(numeric)


def acronyms(zoned: DataFrame) -> DataFrame:
    """doc_id, acronym (flat), name (flat): institutions that article records abbreviate; the first name of an acronym counts."""
    r = zoned.where("in_article").where(F.col("text").rlike(r"\([A-Z]{2,8}[,)]")).select("doc_id", "rec_no", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(ACRONYM), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(ACRONYM), F.lit(2)).alias("short"))).alias("k", "x"))
    return r.groupBy("doc_id", F.lower("x.short").alias("acronym")).agg(F.min_by("x.name", F.struct("rec_no", "k")).alias("name")).withColumn("name", flat(F.col("name")))


def resolve(cited: DataFrame, parsed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Citations with status (matched, review, ambiguous, nomatch or numeric_style), ref_id and candidates.

    Candidates share the flattened surname of the first author (or the institution, or what
    `acronyms` says of it) and the year. One candidate that has the cited authors is the match: a
    second author where the citation names two, three authors or more for "et al.", else one author.
    A single candidate with other authors is for review; several are ambiguous.
    """
    surname = lambda k: F.substring_index(F.get("authors", F.lit(k)), ",", 1)
    key = flat(F.when(F.col("is_institutional"), F.col("authors")[0]).otherwise(surname(0)))
    refs = parsed.where("parsed").select("doc_id", key.alias("who"), "year", F.struct("ref_no", F.col("id").alias("ref"), flat(surname(1)).alias("second"), F.size("authors").alias("size")).alias("r"))
    refs = refs.groupBy("doc_id", "who", "year").agg(F.sort_array(F.collect_list("r")).alias("refs"))
    out = cited.withColumns({"who": flat(F.col("author")), "two": flat(F.col("second"))})
    if known is not None:
        out = out.join(known.withColumnRenamed("acronym", "who"), ["doc_id", "who"], "left").withColumn("who", F.coalesce("name", "who")).drop("name")
    out = out.join(refs, ["doc_id", "who", "year"], "left")
    fits = lambda r: F.when(F.col("second").isNotNull(), (r.second == F.col("two")) & (r.size == 2)).when(F.col("et_al"), r.size >= 3).otherwise(r.size == 1)
    out = out.withColumn("fit", F.filter("refs", fits))
    status = F.when(F.col("number").isNotNull(), "numeric_style").when(F.col("refs").isNull(), "nomatch").when(F.size("fit") == 1, "matched").when(F.size("refs") == 1, "review").otherwise("ambiguous")
    candidates = F.coalesce(F.transform("refs", lambda r: r.ref), F.array().cast("array<string>"))
    return out.select("doc_id", "rec_no", "id", "raw", "parent_raw", "author", "second", "year", "et_al", "number", "last", "n", status.alias("status"), F.when(status == "matched", F.col("fit")[0].ref).alias("ref_id"), candidates.alias("candidates"))


#: Our own rules on the form of APA citations: name, pattern, what is replaced by what.
FORMS = [
    ("ampersand", rf"({NAME} and {NAME},? {YEAR})", r" and ", " & "),
    ("and", rf"({NAME} & {NAME} \({YEAR}\))", r" & ", " and "),
    ("et-al", rf"({NAME} et al,? \(?{YEAR})", r" et al(,?) ", " et al.$1 "),
    ("comma", rf"\(({NAME}(?: & {NAME}| et al\.)? {YEAR})\)", rf" ({YEAR})\z", ", $1"),
]


def forms(zoned: DataFrame) -> DataFrame:
    """doc_id, rec_no, id, k (order in the record), code, correction: citations whose form APA 7 has otherwise, each code once a document."""
    r = zoned.where("in_article").where(F.col("text").rlike(r"(?:19|20)\d{2}")).where(F.col("heading").isNull() | (F.col("heading") != "introduction"))
    mended = lambda a, b: lambda x: F.struct(x.alias("code"), F.regexp_replace(x, a, b).alias("correction"))
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), mended(a, b)) for _, p, a, b in FORMS)))
    r = r.select("doc_id", "rec_no", "id", F.posexplode(found).alias("k", "x")).select("doc_id", "rec_no", "id", "k", "x.code", "x.correction")
    first = F.min(F.struct("rec_no", "k", "id"))
    return r.groupBy("doc_id", "code", "correction").agg(first.alias("f")).select("doc_id", "f.rec_no", "f.id", "f.k", "code", "correction")


def uncited(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Parsed entries that no citation matches or may mean."""
    used = resolved.select("doc_id", F.explode("candidates").alias("id")).distinct()
    return parsed.where("parsed").join(used, ["doc_id", "id"], "left_anti")


def evidence(records: DataFrame, snippets: DataFrame) -> DataFrame:
    """doc_id, snippet, paragraph_id: the first record that holds each (doc_id, snippet), normalised."""
    s = snippets.withColumn("quote", norm(F.col("snippet"))).where("quote <> ''")
    r = records.select("doc_id", "rec_no", "id", norm(F.col("text")).alias("line"))
    hit = s.join(r, "doc_id").where(F.col("line").contains(F.col("quote")))
    return hit.groupBy("doc_id", "snippet", "quote").agg(F.min_by("id", "rec_no").alias("paragraph_id"))
