"""Bibliographic metadata: comparison of reference entries with a `biblio` table, and what follows.

biblio: doi, title, authors (array of family, given, name), years, container, publisher, type,
volume, issue, page, article_number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .records import flat, norm
from .rules import issue

#: Schema of a bibliographic service's JSON records, for `from_json`.
SERVICE = "title array<string>, DOI string, author array<struct<family:string,given:string,name:string>>, issued struct<`date-parts`:array<array<int>>>, published struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, `published-print` struct<`date-parts`:array<array<int>>>, `container-title` array<string>, publisher string, type string, volume string, issue string, page string, `article-number` string"


def biblio(json: DataFrame, column: str = "json") -> DataFrame:
    """A biblio table of a service's records, one JSON object a row."""
    m = json.select(F.from_json(column, SERVICE).alias("m")).select("m.*")
    dates = [F.get(F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0)), F.lit(0)).cast("string") for c in ("issued", "published", "published-online", "published-print")]
    return m.select(F.col("DOI").alias("doi"), F.get("title", F.lit(0)).alias("title"), F.col("author").alias("authors"), F.array_distinct(F.array_compact(F.array(*dates))).alias("years"), F.get("`container-title`", F.lit(0)).alias("container"), "publisher", "type", "volume", "issue", "page", F.col("`article-number`").alias("article_number"))


def compare(pairs: DataFrame) -> DataFrame:
    """Adds fields (name, provided, official, matches), differences, missing, identity and status to rows of r (an entry) and m (a biblio row).

    Title, DOI (if the entry has one), ordered surnames and year are the identity: a field of these
    that differs or is missing breaks it, and so do differing initials.
    """
    r, m = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"m.{c}"))
    surnames = F.array_join(F.transform(r("authors"), lambda a: F.when(r("is_institutional"), a).otherwise(F.substring_index(a, ",", 1))), "; ")
    official = F.array_join(F.transform(F.coalesce(m("authors"), F.array()), lambda a: F.coalesce(F.when(a.family != "", a.family), a["name"], F.lit(""))), "; ")
    article = m("type").eqNullSafe(F.lit("journal-article"))
    yes = F.lit(True)
    spec = [
        (F.lit("title"), r("title"), m("title"), True, yes),
        (F.lit("DOI"), F.lower(r("doi")), F.lower(m("doi")), True, F.coalesce(r("doi"), F.lit("")) != ""),
        (F.lit("authors (ordered surnames)"), surnames, official, True, yes),
        (F.when(article, "journal").otherwise("container / publisher"), F.coalesce(r("journal"), r("publisher")), F.coalesce(F.when(m("container") != "", m("container")), m("publisher")), False, yes),
        (F.lit("volume"), r("volume"), m("volume"), False, article),
        (F.lit("issue"), r("issue"), m("issue"), False, article & (F.coalesce(r("issue"), m("issue"), F.lit("")) != "")),
        (F.lit("pages / article number"), F.coalesce(r("pages"), r("article_number")), F.coalesce(F.when(m("page") != "", m("page")), m("article_number")), False, article),
    ]

    def field(name: Column, provided: Column, official: Column, core: bool, used: Column) -> Column:
        there = (norm(provided) != "") & (norm(official) != "")
        state = F.when(~there, "missing").when(flat(provided) == flat(official), "same").otherwise("differs")
        return F.when(used, F.struct(name.alias("name"), provided.cast("string").alias("provided"), official.cast("string").alias("official"), state.alias("state"), F.lit(core).alias("core")))

    year = F.regexp_replace(F.coalesce(r("year"), F.lit("")), r"(?i)[a-z]\z", "")
    known = F.coalesce(m("years"), F.array())
    state = F.when((year == "") | (F.size(known) == 0), "missing").when(F.array_contains(known, year), "same").otherwise("differs")
    of_year = F.struct(F.lit("year").alias("name"), year.alias("provided"), F.array_join(known, " / ").alias("official"), state.alias("state"), F.lit(True).alias("core"))
    fields = [field(*x) for x in spec]
    out = pairs.withColumn("all", F.array_compact(F.array(*fields[:3], of_year, *fields[3:])))
    # initials are compared where both sides have them; they are ASCII or not, letters only
    given = F.transform(r("authors"), lambda a, i: F.struct(F.regexp_extract(a, r",\s*(.*)\z", 1).alias("own"), F.coalesce(F.get(m("authors"), i).given, F.lit("")).alias("given"), (i + 1).alias("k")))
    letters = lambda c: F.collate(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), "UNICODE_CI_AI")
    capitals = lambda c: F.regexp_extract_all(c, F.lit(r"(\p{Lu})"), F.lit(1))
    initials = F.transform(given, lambda x: F.struct(F.concat(F.lit("author initials "), x.k).alias("name"), x.own.alias("provided"), F.concat(F.array_join(capitals(x.given), ". "), F.lit(".")).alias("official"), F.when(letters(x.own) == "", "same").when(x.given == "", "missing").when(~x.given.rlike(r"\p{Lu}"), "same").when(letters(x.own) == letters(F.array_join(capitals(x.given), "")), "same").otherwise("differs").alias("state"), F.lit(False).alias("core")))
    out = out.withColumn("initials", F.filter(initials, lambda x: x.state != "same"))
    every = F.concat("all", "initials")
    out = out.withColumns({
        "fields": F.transform(F.filter("all", lambda x: x.state != "missing"), lambda x: F.struct(x["name"].alias("name"), x.provided.alias("provided"), x.official.alias("official"), (x.state == "same").alias("matches"))),
        "differences": F.transform(F.filter(every, lambda x: x.state == "differs"), lambda x: F.struct(x["name"].alias("name"), x.provided.alias("provided"), x.official.alias("official"))),
        "missing": F.transform(F.filter(every, lambda x: x.state == "missing"), lambda x: x["name"]),
        "identity": ~F.exists("all", lambda x: x.core & (x.state != "same")) & ~F.exists("initials", lambda x: x.state == "differs"),
    }).drop("all", "initials")
    status = F.when(F.size("differences") > 0, "metadata_mismatch").when(F.size("missing") > 0, "partial_match").otherwise("metadata_verified")
    return out.withColumn("status", status)


def verify(refs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, id, status, checked, lookup, doi, identity, differences, missing, reason of each entry.

    An entry with a DOI is compared with the record of that DOI; a parsed one without is looked up
    by its flattened title and counts only if exactly one record with a DOI is identical.
    """
    pack = lambda df, name: df.select(F.struct("*").alias(name))
    key = pack(table, "m").withColumns({"by_doi": F.lower("m.doi"), "by_title": flat(F.col("m.title"))})
    r = pack(refs, "r").withColumns({"doi_key": F.lower("r.doi"), "title_key": flat(F.col("r.title"))})
    cols = ["r", "status", "identity", "differences", "missing"]
    one = key.groupBy("by_doi").agg(F.min_by("m", F.to_json("m")).alias("m"))  # of several, the first as text
    direct = compare(r.where("doi_key is not null").join(one, F.col("doi_key") == F.col("by_doi"))).select(*cols, F.col("m.doi").alias("doi"), F.lit("doi").alias("lookup"))
    searched = compare(r.where("doi_key is null and r.parsed").join(key, F.col("title_key") == F.col("by_title"))).where("identity")
    searched = searched.groupBy("r").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in cols[1:]), F.first("m.doi").alias("doi"))
    unique = searched.where("n = 1 and doi is not null").select(*cols, "doi", F.lit("metadata").alias("lookup"))
    told = direct.unionByName(unique).select(F.col("r.doc_id").alias("doc_id"), F.col("r.id").alias("id"), *cols[1:], "doi", "lookup")
    many = searched.where("n > 1").select(F.col("r.doc_id").alias("doc_id"), F.col("r.id").alias("id"), F.lit(True).alias("many"))
    out = refs.select("doc_id", "id", "parsed", F.col("doi").alias("own")).join(told, ["doc_id", "id"], "left").join(many, ["doc_id", "id"], "left")
    reason = F.when(F.col("status") == "metadata_mismatch", "Fetched metadata differs from the supplied reference.").when(F.col("status") == "partial_match", "Some fields were matched; other fields could not be compared.").when(F.col("status") == "metadata_verified", "All compared bibliographic fields matched the fetched record.")
    reason = reason.when(F.col("many"), "Multiple candidate records require disambiguation.").when(F.col("parsed") | F.col("own").isNotNull(), "No uniquely matching metadata record was established. Absence of a DOI has not been proven.").otherwise("The reference could not be parsed reliably; verify it on an official source page.")
    return out.select("doc_id", "id", F.coalesce("status", F.lit("unverified")).alias("status"), (F.col("parsed") | F.col("own").isNotNull()).alias("checked"), "lookup", "doi", F.coalesce("identity", F.lit(False)).alias("identity"), "differences", "missing", reason.alias("reason"))


def verification_issues(refs: DataFrame, verified: DataFrame, records: DataFrame) -> DataFrame:
    """Issues of section 4: mismatch, missing DOI, DOI not written as a URL, no-DOI conflict, in the order of entries.

    refs are entries with record_ids, whose texts in `records` are the evidence.
    """
    v = refs.select("doc_id", "ref_no", "id", "raw", "record_ids", F.col("doi").alias("own")).join(verified, ["doc_id", "id"])
    url = lambda c: F.concat(F.lit("https://doi.org/"), c)
    one = lambda k, kind, correction: F.struct(F.lit(k).alias("k"), F.lit(f"verification-{kind}").alias("kind"), correction.alias("correction"))
    found = F.array_compact(F.array(
        F.when(F.col("status") == "metadata_mismatch", one(0, "mismatch", F.lit(""))),
        F.when(F.col("identity") & F.col("doi").isNotNull() & F.col("own").isNull(), one(1, "doi-missing", url(F.col("doi")))),
        F.when(F.col("own").isNotNull() & ~F.col("raw").contains(url(F.col("own"))), one(2, "doi-format", url(F.col("own")))),
        F.when((F.col("status") == "verified_no_doi") & F.col("own").isNotNull(), one(3, "no-doi-conflict", F.lit(""))),
    ))
    v = v.select("doc_id", "ref_no", "id", "raw", "record_ids", "differences", F.inline(found))
    quotes = v.select("doc_id", "id", F.posexplode("record_ids").alias("n", "pid")).distinct().join(records.select("doc_id", F.col("id").alias("pid"), "text"), ["doc_id", "pid"])
    quotes = quotes.groupBy("doc_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "pid", "text"))), lambda x: F.struct(x.pid.alias("paragraph_id"), x.text.alias("quote"))).alias("evidence"))
    v = v.join(quotes, ["doc_id", "id"], "left").withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy("ref_no", "k")) - 1)
    shown = F.array_join(F.transform(F.coalesce("differences", F.array()), lambda d: F.concat(d["name"], F.lit(": "), d.provided, F.lit(" / "), d.official)), "; ")
    return issue(v, F.col("kind"), 4, F.col("at"), F.concat_ws("-", F.lit("verification"), "id", "at"), [F.col("id"), shown], F.col("evidence"), False, F.array("raw"), F.col("correction"), "verification")


def editor_override(verified: DataFrame, decisions: DataFrame) -> DataFrame:
    """Verification rows with editors' decisions (doc_id, id, new_status, url, why) applied.

    A decision needs an https address without credentials and a reason; others are left out.
    """
    ok = F.col("url").rlike(r"(?i)^https://[^/@\s]+\.[^/@\s]+(?:/|\z)") & ~F.col("url").rlike(r"(?i)^https://[^/]*(?:localhost|127\.0\.0\.1)") & (norm(F.col("why")) != "") & F.col("new_status").isin("editor_verified", "verified_no_doi")
    d = decisions.where(ok).select("doc_id", "id", "new_status", "why")
    out = verified.join(d, ["doc_id", "id"], "left")
    return out.withColumns({"lookup": F.when(F.col("new_status").isNotNull(), "editor").otherwise(F.col("lookup")), "reason": F.coalesce("why", "reason"), "status": F.coalesce("new_status", "status")}).drop("new_status", "why")
