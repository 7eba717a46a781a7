"""Scalar functions and zones of the editorial audit.

Records are (doc_id, rec_no, id, text, part, kind, style, highlighted) in order of rec_no; a null
part is the document's main part, a null kind is body text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ...functions.text import WS, trim

MAIN = "word/document.xml"
# fixed values: patterns that decide results, in their order
HEADINGS = [
    ("abstract", rf"(?i)^(?:abstract|abstrak)(?![A-Za-z0-9_])[{WS}]*[:.\-]?[{WS}]*"),
    ("keywords", rf"(?i)^(?:keywords?|kata[{WS}]*kunci)(?![A-Za-z0-9_])[{WS}]*[:.\-]?[{WS}]*"),
    ("introduction", r"(?i)^(?:introduction|pendahuluan|background)\z"),
    ("methods", rf"(?i)^(?:research[{WS}]+)?(?:methods?|methodology|materials[{WS}]+and[{WS}]+methods|metode(?:[{WS}]+penelitian)?)\z"),
    ("results", rf"(?i)^(?:research[{WS}]+)?(?:results?|findings?)(?:[{WS}]*(?:and|&)[{WS}]*discussion)?\z"),
    ("discussion", r"(?i)^(?:discussion|pembahasan)\z"),
    ("conclusion", rf"(?i)^(?:conclusions?|kesimpulan)(?:[{WS}]*(?:and|&)[{WS}]*(?:recommendations?|implications?|suggestions?))?\z"),
    ("contribution", rf"(?i)^(?:authors?['’]?[{WS}]+contributions?(?:[{WS}]+statement)?|contributions?[{WS}]+of[{WS}]+(?:the[{WS}]+)?authors?|credit(?:[{WS}]+authorship)?(?:[{WS}]+contribution)?[{WS}]+statement)\z"),
    ("ethics", rf"(?i)^(?:research[{WS}]+ethics|ethical[{WS}]+(?:approval|considerations?|statement)|ethics[{WS}]+(?:approval|statement))\z"),
    ("references", rf"(?i)^(?:references?|reference[{WS}]+list|bibliography|daftar[{WS}]+pustaka|refernces|refrences)\z"),
    ("other", rf"(?i)^(?:acknowledge?ments?|funding(?:[{WS}]+statement)?|conflicts?[{WS}]+of[{WS}]+interest|declaration[{WS}]+of[{WS}]+interests?|data[{WS}]+availability(?:[{WS}]+statement)?|appendi(?:x|ces)(?:[{WS}]+[A-Z0-9]+)?|supplementary[{WS}]+materials?)\z"),
]
NUMBERING = rf"^(?:\d+(?:\.\d+)*|[IVX]+)[.){WS}]+[{WS}]*"
FRONT_MATTER = rf"(?i)^(?:how[{WS}]+to[{WS}]+cite|to[{WS}]+cite[{WS}]+this|received[{WS}]*:|accepted[{WS}]*:|revised[{WS}]*:|copyright[{WS}]|©)"
#: Characters of a normalised line that decide whether it is a heading or front matter: no pattern is as long.
START = 120
EXTRA_KINDS = ("textbox", "footnote", "endnote")


@dataclass(frozen=True)
class Limits:
    """Journal limits; blank values take the defaults, others must be whole numbers in range."""

    abstract_max: int = 250
    reference_min: int = 35
    manuscript_max: int = 9000

    @classmethod
    def of(cls, **values) -> Limits:
        ranges, out = {"abstract_max": (1, 10_000), "reference_min": (0, 5_000), "manuscript_max": (1, 1_000_000)}, {}
        for name, value in values.items():
            if value is None or value == "":
                continue
            low, high = ranges[name]
            n = float(value)
            if n != int(n) or not low <= n <= high:
                raise ValueError(f"{name} must be a whole number from {low} to {high}")
            out[name] = int(n)
        return cls(**out)


def _normal(form: str):
    @F.pandas_udf(StringType())
    def run(s):
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t), na_action="ignore")

    return run


@F.pandas_udf(StringType())
def _flat(s):
    def one(t):
        t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t).lower())
        return "".join(c for c in t if unicodedata.category(c)[0] in "LN")

    return s.map(one, na_action="ignore")


def _composed(c: Column, form: str) -> Column:
    """The normal form; ASCII texts stay in the JVM."""
    ascii_ = c.rlike(r"^[\x00-\x7f]*\z")
    return F.coalesce(_normal(form)(F.when(~ascii_, c)), c)


def norm(c: Column) -> Column:
    return trim(F.regexp_replace(_composed(F.coalesce(c, F.lit("")), "NFKC"), f"[{WS}]+", " "))


def flat(c: Column) -> Column:
    """Letters and digits only, lower case, without accents."""
    c = F.coalesce(c, F.lit(""))
    ascii_ = c.rlike(r"^[\x00-\x7f]*\z")
    return F.coalesce(_flat(F.when(~ascii_, c)), F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))


def words(c: Column) -> Column:
    """Words as a word processor counts them, nearly: dashes between words split, those between digits don't, East Asian characters count each."""
    c = F.coalesce(c, F.lit(""))
    t = F.replace(_composed(c, "NFC"), F.lit("­"), F.lit(""))
    t = F.regexp_replace(t, r"(?<=\d)[‒–](?=\d)", "-")
    t = F.regexp_replace(t, r"[‒-―​]", " ")
    t = F.regexp_replace(t, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", " $0 ")
    # from a word's first letter or digit on; ASCII texts hold nothing of the above
    return F.when(c.rlike(r"^[\x00-\x7f]*\z"), F.regexp_count(c, F.lit(r"[A-Za-z0-9][^\t-\r ]*"))).otherwise(F.regexp_count(t, F.lit(rf"[\p{{L}}\p{{N}}][^{WS}]*")))


def quote(c: Column) -> Column:
    return F.concat(F.lit("“"), norm(c), F.lit("”"))


def limit(c: Column, n: int) -> Column:
    t = norm(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def _title(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, NUMBERING, ""), rf"[:.][{WS}]*\z", "")


def with_headings(records: DataFrame) -> DataFrame:
    """Records with normal (their norm), heading (key or null) and rest (what follows the heading in its line)."""
    r = records.withColumn("normal", norm(F.col("text"))).withColumn("title", _title(F.col("normal")))
    kind, key, rest = F.coalesce("kind", F.lit("body")), None, None
    for name, pattern in HEADINGS:
        # patterns to the end of the line fit no long line, the others look at its start
        start = F.when(F.length("title") <= START, F.col("title")) if pattern.endswith(r"\z") else F.substring("title", 1, START)
        hit = start.rlike(pattern) & (kind.isin("body", "textbox") | ((kind == "table") & F.lit(name in ("abstract", "keywords"))))
        key = F.when(hit, name) if key is None else key.when(hit, name)
        after = F.regexp_replace("title", pattern, "")
        rest = F.when(hit, after) if rest is None else rest.when(hit, after)
    return r.withColumns({"heading": key, "rest": rest}).drop("title")


def zones(records: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Records with section, in_abstract, abstract_part (its text within the abstract), in_references, in_article and the document's abstract_found, abstract_bounded and reference_found.

    overrides: (doc_id, reference_start, abstract_start, abstract_end) by record id, nulls for none.
    An abstract that ends before it starts is an error.
    """
    r = with_headings(records).withColumn("main", F.coalesce(F.col("part") == MAIN, F.lit(True)))
    doc, order = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("rec_no")
    cols = ("reference_start", "abstract_start", "abstract_end")
    r = r.join(overrides.select("doc_id", *cols), "doc_id", "left") if overrides is not None else r.withColumns({c: F.lit(None).cast("string") for c in cols})
    first = lambda c: F.min(F.when(F.col("main") & c, F.col("rec_no"))).over(doc)
    chosen = lambda c, key: F.when(F.col(c).isNotNull(), first(F.col("id") == F.col(c))).otherwise(first(F.col("heading") == key))
    r = r.withColumns({"ref_start": chosen("reference_start", "references"), "abs_start": chosen("abstract_start", "abstract")})
    after = lambda start, key: first((F.col("rec_no") > F.col(start)) & (F.col("heading") != key))
    r = r.withColumns({"ref_end": after("ref_start", "references"), "abs_next": after("abs_start", "abstract"), "abs_last": first(F.col("id") == F.col("abstract_end"))})
    wrong = F.raise_error(F.lit("the abstract's end lies before its start")).cast("boolean")
    given = F.col("abstract_end").isNotNull()
    r = r.withColumn("ok", F.when(given & F.coalesce(F.col("abs_last") < F.col("abs_start"), F.lit(True)), wrong).otherwise(True)).where("ok").drop("ok")
    in_refs = F.col("main") & (F.col("rec_no") > F.col("ref_start")) & F.coalesce(F.col("rec_no") < F.col("ref_end"), F.lit(True)) & (F.col("normal") != "")
    ends = F.when(given, F.col("rec_no") <= F.col("abs_last")).otherwise(F.coalesce(F.col("rec_no") < F.col("abs_next"), F.lit(True)))
    in_abs = F.col("main") & (F.col("rec_no") >= F.col("abs_start")) & ends & F.coalesce("kind", F.lit("body")).isin("body", "table", "textbox")
    r = r.withColumns({"in_references": F.coalesce(in_refs, F.lit(False)), "in_abstract": F.coalesce(in_abs, F.lit(False))})
    filled = F.last(F.when(F.col("main"), F.col("heading")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    section = F.when(F.col("in_references"), "references").when(F.col("main"), F.coalesce(filled, F.lit("front"))).otherwise(F.coalesce("kind", F.lit("other")))
    article = ~F.col("in_references") & ~F.coalesce("kind", F.lit("body")).isin("header", "footer") & ~F.substring("normal", 1, START).rlike(FRONT_MATTER)
    part = F.when(F.col("in_abstract"), F.when((F.col("heading") == "abstract") & (F.row_number().over(W.partitionBy("doc_id", "in_abstract").orderBy("rec_no")) == 1), F.col("rest")).otherwise(F.col("text")))
    facts = {"section": section, "in_article": article, "abstract_part": part, "reference_found": F.col("ref_start").isNotNull(), "abstract_found": F.col("abs_start").isNotNull(), "abstract_bounded": F.col("abs_start").isNotNull() & (given | F.col("abs_next").isNotNull())}
    return r.withColumns(facts).drop(*cols, "ref_start", "ref_end", "abs_start", "abs_next", "abs_last")


def document_words(records: DataFrame, include_extra: bool = True) -> DataFrame:
    """doc_id, main, extra and total words; headers and footers don't count."""
    n, kind = words(F.col("text")), F.coalesce("kind", F.lit("body"))
    r = records.where(~kind.isin("header", "footer")).withColumn("n", n).groupBy("doc_id").agg(F.sum(F.when(~kind.isin(*EXTRA_KINDS), F.col("n")).otherwise(0)).alias("main"), F.sum(F.when(kind.isin(*EXTRA_KINDS), F.col("n")).otherwise(0)).alias("extra"))
    return r.withColumn("total", F.col("main") + F.col("extra") if include_extra else F.col("main"))


def abstracts(zoned: DataFrame) -> DataFrame:
    """doc_id, abstract, words, found, bounded of every document."""
    parts = F.sort_array(F.collect_list(F.when(F.col("in_abstract"), F.struct("rec_no", "abstract_part"))))
    out = zoned.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x.abstract_part), "\n").alias("abstract"), F.max("abstract_found").alias("found"), F.max("abstract_bounded").alias("bounded"))
    return out.withColumn("words", words(F.col("abstract")))
