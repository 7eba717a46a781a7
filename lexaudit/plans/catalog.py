"""Queries of the text checks and the editorial audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors as D
from ..operators import report as P
from ..operators import semantic as S
from ..operators import tokens as K
from ..operators.audit import metadata as M
from ..operators.audit import records as R
from ..operators.audit import references as C
from ..operators.audit import report as AP
from ..operators.audit import rules as U
from ..scratch import Scratch
from . import sql as Q

#: Vectors of `embeddings` stand for candidate terms, so many to a document.
TERMS = 70


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _added(docs: DataFrame, texts: list[str], gap: str) -> DataFrame:
    more: Column | None = None
    for k, t in enumerate(texts):
        hit = F.col("doc_id") % len(texts) == k
        more = F.when(hit, t) if more is None else more.when(hit, t)
    return docs.select("doc_id", F.concat("text", F.lit(gap), more).alias("text"))


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _added(documents(spark, sf_dir), Q.FIXTURES, "\n\n")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document, with a manuscript's lines after it, as a body record."""
    docs = _added(documents(spark, sf_dir), Q.MANUSCRIPT, "\n")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return rows.select("doc_id", (F.col("k") + 1).alias("rec_no"), F.concat(F.lit("P"), F.lpad((F.col("k") + 1).cast("string"), 4, "0")).alias("id"), "text", F.lit(R.MAIN).alias("part"), F.lit("body").alias("kind"), F.lit(None).cast("string").alias("style"), (F.col("k") % 11 == 3).alias("highlighted"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing image, a coarse one and a clear one for every fifth document."""
    docs = documents(spark, sf_dir).where("doc_id % 5 = 0")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("img_no")).select("doc_id", "img_no", F.concat(F.lit("rId"), "doc_id").alias("relationship_id"), (F.col("img_no") == 0).alias("missing"), F.when(F.col("img_no") == 1, 72.4).when(F.col("img_no") == 2, 300.0).alias("dpi"))


def biblio(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(Q.BIBLIO, "doi string, title string, authors array<struct<family:string,given:string,name:string>>, years array<string>, container string, publisher string, type string, volume string, issue string, page string, article_number string")


def _flat(v: DataFrame) -> DataFrame:
    return v.select("doc_id", "category", "key", "form", "n")


def _detect(name: str, aug: bool = False, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = (augmented if aug else documents)(spark, sf_dir)
        if name == "undefined":
            d = K.plain(docs)
            return _flat(D.undefined_acronyms(K.tokens(d), d))
        return _flat(D.all_variants(docs, checks={name}, **options))

    return run


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.all_variants(augmented(spark, sf_dir), check_undefined=True)


def _toks(spark: SparkSession, sf_dir: str, aug: bool = False) -> DataFrame:
    return K.tokens(K.plain((augmented if aug else documents)(spark, sf_dir)))


def word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.word_count("text").cast("long").alias("words"))


def tokens(spark, sf_dir):
    return _toks(spark, sf_dir, True).select("doc_id", "text", "start", F.col("end").alias("stop"), "usable", "boundary")


def lines_flags(spark, sf_dir):
    return K.lines(augmented(spark, sf_dir)).select("doc_id", "line_no", "excluded", "after_refs")


def vocabulary(spark, sf_dir):
    return K.vocabulary(_toks(spark, sf_dir))


def findings_union(spark, sf_dir):
    return _flat(_all(spark, sf_dir))


def findings_summary(spark, sf_dir):
    g = _all(spark, sf_dir).groupBy("doc_id", "category", "key").agg(F.sum("n").alias("n"))
    return g.groupBy("category").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_uses"), F.count_distinct("doc_id").alias("n_docs"))


def severity_summary(spark, sf_dir):
    return _all(spark, sf_dir).select("doc_id", "category", "key").distinct().groupBy(P.severity().alias("severity")).agg(F.count("*").alias("n_groups"))


def flagged_forms(spark, sf_dir):
    return S.flagged_forms(_all(spark, sf_dir))


def candidate_words(spark, sf_dir):
    return S.candidate_words(_toks(spark, sf_dir)).select("doc_id", "term", F.col("n").alias("n"), "place")


def candidate_phrases(spark, sf_dir):
    return S.candidate_phrases(augmented(spark, sf_dir)).select("doc_id", "term", "n", "place")


def candidate_bigrams(spark, sf_dir):
    return S.candidate_bigrams(K.bigrams(_toks(spark, sf_dir))).select("doc_id", "term", "n", "place")


def candidates_all(spark, sf_dir):
    docs = augmented(spark, sf_dir)
    toks = K.tokens(K.plain(docs), keep=True)
    return S.candidates(docs, S.flagged_forms(D.all_variants(docs, check_undefined=True, toks=toks)), toks=toks)


def cosine_pairs(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / TERMS).alias("doc_id"), (F.col("vec_id") % TERMS).alias("rank"), F.col("vec_id").cast("string").alias("term"), "embedding")
    return S.similar_pairs(v, 0.35).select("doc_id", "a", "b", F.round("similarity", 6).alias("similarity"))


def contexts(spark, sf_dir):
    t = _toks(spark, sf_dir, True).where(F.col("text").rlike(r"^[A-Z]{2,8}\z"))
    return t.select("doc_id", F.col("text").alias("term"), "start", "end").join(augmented(spark, sf_dir), "doc_id").select("doc_id", "term", "start", T.snippet(F.col("text"), F.col("start"), F.col("end")).alias("context"))


def term_occurrences(spark, sf_dir):
    docs = augmented(spark, sf_dir)
    terms = docs.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("audit committee"), F.lit("de la"))).alias("term"))
    return S.term_occurrences(docs, terms).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"))


def finding_contexts(spark, sf_dir):
    docs = augmented(spark, sf_dir)
    return P.with_contexts(D.findings(docs, check_undefined=True), docs).withColumn("contexts", F.array_join("contexts", "\n"))


def markdown_report(spark, sf_dir):
    return P.markdown_of_texts(augmented(spark, sf_dir), check_undefined=True)


def html_report(spark, sf_dir):
    return P.html_of_texts(augmented(spark, sf_dir), date="January 1, 2026", check_undefined=True)


def annotated(spark, sf_dir):
    docs = augmented(spark, sf_dir)
    return P.annotate(docs, S.flagged_forms(D.all_variants(docs, check_undefined=True)))


def _zones(spark, sf_dir):
    return R.zones(records(spark, sf_dir))


def audit_words(spark, sf_dir):
    return R.document_words(records(spark, sf_dir)).select("doc_id", "main", "extra", "total")


def audit_zones(spark, sf_dir):
    return _zones(spark, sf_dir).select("doc_id", "id", "section", "in_abstract", "in_references", "in_article", "abstract_bounded")


def audit_abstracts(spark, sf_dir):
    return R.abstracts(_zones(spark, sf_dir))


def audit_reference_islands(spark, sf_dir):
    return C.entries(_zones(spark, sf_dir)).select("doc_id", "ref_no", "id", "raw", F.array_join("record_ids", ",").alias("record_ids"))


def _parsed(spark, sf_dir):
    return C.parse(C.entries(_zones(spark, sf_dir)))


def audit_references(spark, sf_dir):
    return _parsed(spark, sf_dir).withColumns({"authors": F.array_join("authors", "; "), "record_ids": F.array_join("record_ids", ",")})


def audit_duplicates(spark, sf_dir):
    return C.duplicates(_parsed(spark, sf_dir)).withColumn("ids", F.array_join("ids", ","))


def audit_citations(spark, sf_dir):
    z = _zones(spark, sf_dir)
    return C.resolve(C.citations(z), C.parse(C.entries(z)), C.acronyms(z)).withColumn("candidates", F.array_join("candidates", ","))


def audit_captions(spark, sf_dir):
    return U.captions(_zones(spark, sf_dir)).select("doc_id", "id", "type", F.col("number").cast("string").alias("digits"))


def audit_callouts(spark, sf_dir):
    return U.caption_rules(_zones(spark, sf_dir)).where("id like 'callout-%'").select("doc_id", "id")


def audit_caption_numbers(spark, sf_dir):
    return U.caption_rules(_zones(spark, sf_dir)).where("id not like 'callout-%'").select("doc_id", "id")


def audit_placeholders(spark, sf_dir):
    return U.record_rules(_zones(spark, sf_dir)).where("id like 'placeholder-%'").select("doc_id", "id", F.array_join("examples", "|").alias("examples"))


def audit_blank_dates(spark, sf_dir):
    return U.record_rules(_zones(spark, sf_dir)).where("id like 'blank-date-%'").select("doc_id", "id")


def audit_length_rules(spark, sf_dir):
    return U.lengths(_zones(spark, sf_dir), R.Limits(4, 35, 300)).select("doc_id", "id")


def _issues(spark, sf_dir):
    return U.audit(records(spark, sf_dir), images(spark, sf_dir)).persist()  # most readers read it several times


def audit_issues(spark, sf_dir):
    shown = F.transform("evidence", lambda e: F.concat(e.paragraph_id, F.lit("="), e.quote))
    return _issues(spark, sf_dir).select("doc_id", "rule", "spot", "id", "kind", "section", "review", "problem", "action", F.array_join(shown, "|").alias("evidence"), F.array_join("examples", "|").alias("examples"), "correction")


def audit_issue_numbering(spark, sf_dir):
    return AP.numbered(_issues(spark, sf_dir)).select("doc_id", "id", "section", "group", "number")


def audit_comments(spark, sf_dir):
    return AP.comments(AP.numbered(_issues(spark, sf_dir)), records(spark, sf_dir))


def _verified(spark, sf_dir):
    refs = _parsed(spark, sf_dir).persist()
    return refs, M.verify(refs, biblio(spark))


def audit_verification(spark, sf_dir):
    shown = F.array_join(F.transform("differences", lambda d: F.concat(d["name"], F.lit(": "), d.provided, F.lit(" / "), d.official)), "; ")
    return _verified(spark, sf_dir)[1].withColumns({"differences": F.coalesce(shown, F.lit("")), "missing": F.coalesce(F.array_join("missing", ", "), F.lit(""))})


def audit_verification_issues(spark, sf_dir):
    refs, verified = _verified(spark, sf_dir)
    return M.verification_issues(refs, verified, records(spark, sf_dir)).select("doc_id", "section", "spot", F.col("args")[0].alias("ref"), "kind", "correction")


def audit_manual(spark, sf_dir):
    first = records(spark, sf_dir).where("id = 'P0001'").select("doc_id", "text")
    rows = spark.createDataFrame(Q.MANUAL, "item int, section int, comment string, pid string, quote string")
    quote = F.array(F.struct(F.col("pid").alias("paragraph_id"), F.coalesce("quote", "text").alias("quote")))
    items = first.join(F.broadcast(rows)).select("doc_id", "item", "section", "comment", F.when(F.col("pid").isNotNull(), quote).otherwise(F.array().cast(U.EVIDENCE)).alias("evidence"))
    dois = _parsed(spark, sf_dir).where("doi is not null").select("doc_id", "doi")
    return U.validate_manual(items, records(spark, sf_dir), dois).select("doc_id", "item", "error")


def _numbers(spark, sf_dir):
    """Every step is a table that the next ones read: none is computed twice, and no plan grows with the steps before."""
    keep = Scratch(spark, "audit").keep
    z = keep(_zones(spark, sf_dir).drop("rest", "style"), "zones")
    refs = keep(C.parse(C.entries(z)), "references")
    duplicates, resolved = keep(C.duplicates(refs), "duplicates"), keep(C.resolve(C.citations(z), refs, C.acronyms(z)), "citations")
    verified = keep(M.verify(refs, biblio(spark)), "verified")
    columns = lambda df: df.select("doc_id", "rule", "spot", "id", "kind", "section", "review", "args", "evidence", "examples", "correction", "source", "selected")
    counted = keep(R.document_words(z), "words"), keep(R.abstracts(z), "abstracts")
    found = U.audit_zoned(z, images(spark, sf_dir), read=(refs, duplicates, resolved), counted=counted)
    issues = keep(columns(found).unionByName(columns(M.verification_issues(refs, verified, z))), "issues")
    return keep, z, refs, verified, issues, AP.summary(z, refs, resolved, duplicates, verified, issues, counted=counted)


def audit_summary(spark, sf_dir):
    out = _numbers(spark, sf_dir)[-1]
    return out.select("doc_id", *(F.col(c) if c == "reference_found" else F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in out.columns[1:]))


def audit_letters(spark, sf_dir):
    """Letters in English or Indonesian, by document."""
    keep, z, refs, verified, issues, numbers = _numbers(spark, sf_dir)
    manuscripts = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("M-"), "doc_id").alias("manuscript_id"), (F.col("doc_id") % 2 == 0).alias("confirmed"), F.when(F.col("doc_id") % 3 == 0, 1234).alias("saved_words"), F.array().cast("array<string>").alias("warnings"))
    told = refs.select("doc_id", "ref_no", "id", "raw").join(verified.select("doc_id", "id", "status", "reason"), ["doc_id", "id"])
    parts, out = (keep(numbers, "numbers"), keep(AP.numbered(issues), "items"), keep(told, "told"), z), None
    for k, lang in enumerate(("en", "id")):
        own = [df.where(F.col("doc_id") % 2 == k) for df in (manuscripts, *parts)]
        some = AP.letters(keep(AP.report(*own, lang), f"report-{lang}"), lang)
        out = some if out is None else out.unionByName(some)
    return out


_PLAIN = (word_count, tokens, lines_flags, vocabulary, findings_union, findings_summary, severity_summary, flagged_forms, candidate_words, candidate_phrases, candidate_bigrams, candidates_all, cosine_pairs, contexts, term_occurrences, finding_contexts, markdown_report, html_report, annotated, audit_words, audit_zones, audit_abstracts, audit_reference_islands, audit_references, audit_duplicates, audit_citations, audit_captions, audit_callouts, audit_caption_numbers, audit_placeholders, audit_blank_dates, audit_length_rules, audit_issues, audit_issue_numbering, audit_comments, audit_verification, audit_verification_issues, audit_manual, audit_summary, audit_letters)


def queries() -> dict:
    found = {
        "case_variants": _detect("case"),
        "hyphenation_aug": _detect("hyphenation", True),
        "identifier_styles_aug": _detect("identifier", True),
        "spelling_mix": _detect("spelling"),
        "glossary_hits_aug": _detect("glossary", True),
        "acronym_conflicts_aug": _detect("acronym", True),
        "undefined_acronyms": _detect("undefined"),
        "phrase_casing": _detect("phrase"),
        "phrase_reorder": _detect("reorder"),
    }
    found |= {f"fuzzy_s{s}": _detect("fuzzy", sensitivity=s) for s in D.SENSITIVITY}
    return found | {f.__name__: f for f in _PLAIN}


def oracle_sql() -> dict[str, str]:
    aug, tops = Q.AUGMENTED, f"with {Q.PLAIN}, {Q.GRAMS}"
    snip = lambda t, a, b: f"(case when greatest({a} - 45, 0) > 0 then '…' else '' end) || {Q.trim(f'regexp_replace(substr({t}, greatest({a} - 45, 0) + 1, least({b} + 45, length({t})) - greatest({a} - 45, 0)), {Q.q(f'[{T.WS}]+')}, chr(32), chr(103))')} || (case when least({b} + 45, length({t})) < length({t}) then '…' else '' end)"
    out = {
        "case_variants": Q.detector("case"),
        "hyphenation_aug": Q.detector("hyphenation", aug),
        "identifier_styles_aug": Q.detector("identifier", aug),
        "spelling_mix": Q.detector("spelling"),
        "glossary_hits_aug": Q.detector("glossary", aug),
        "acronym_conflicts_aug": Q.detector("acronym", aug),
        "undefined_acronyms": Q.detector("undefined"),
        "phrase_casing": Q.detector("phrase"),
        "phrase_reorder": Q.detector("reorder"),
        "word_count": f"with {Q.PLAIN} select doc_id, cast(len(regexp_extract_all(text, {Q.q(T.TOKEN)})) as bigint) as words from doc",
        "tokens": f"with {aug}, {Q.TOKENS} select doc_id, text, start, stop, usable, boundary from tok",
        "lines_flags": f"with {aug}, {Q.LINES} select doc_id, cast(line_no as int) as line_no, excluded, after_refs from line",
        "vocabulary": f"with {Q.PLAIN}, {Q.VOCAB} select * from vocab",
        "findings_union": f"{Q.union()} select doc_id, category, key, form, cast(n as bigint) as n from found",
        "findings_summary": f"{Q.union()} select category, count(*) as n_groups, cast(sum(n) as bigint) as n_uses, count(distinct doc_id) as n_docs from (select doc_id, category, key, sum(n) as n from found group by 1, 2, 3) group by 1",
        "severity_summary": f"{Q.union()} select case when category in {Q.names([k for k, v in P.CATEGORIES.items() if v[1] == 'error'])} then 'error' when category in {Q.names([k for k, v in P.CATEGORIES.items() if v[1] == 'warning'])} then 'warning' else 'suggestion' end as severity, count(*) as n_groups from (select distinct doc_id, category, key from found) group by 1",
        "flagged_forms": f"{Q.union()}, {Q.FLAGGED} select doc_id, form from flagged where form <> ''",
        "candidate_words": f"{tops} select doc_id, term, n, place from ({Q.top(Q.WORDS, S.WORDS)})",
        "candidate_phrases": f"with {aug}, {Q.LINES} select doc_id, term, n, place from ({Q.top(Q.PHRASES, S.PHRASES)})",
        "candidate_bigrams": f"{tops} select doc_id, term, n, place from ({Q.top(Q.BIGRAMS, S.BIGRAMS)})",
        "candidates_all": f"""{Q.union()}, {Q.FLAGGED},
            w as ({Q.top(f'select * from ({Q.WORDS}) x where not exists (select 1 from flagged f where f.doc_id = x.doc_id and f.form = x.term)', S.WORDS)}),
            p as ({Q.top(f'select * from ({Q.PHRASES}) x where not exists (select 1 from flagged f where f.doc_id = x.doc_id and f.form = lower(x.term))', S.PHRASES)}),
            b as (select * from ({Q.top(Q.BIGRAMS, S.BIGRAMS)}) x where not exists (select 1 from flagged f where f.doc_id = x.doc_id and f.form = x.term) and not exists (select 1 from p where p.doc_id = x.doc_id and lower(p.term) = x.term)),
            u as (select 0 as o, 'word' as kind, * from w union all select 1, 'phrase', * from p union all select 2, 'bigram', * from b)
            select doc_id, cast(rank as int) as rank, kind, term, n from (select *, row_number() over (partition by doc_id order by o, place) as rank from u) where rank <= {S.TOTAL}""",
        "cosine_pairs": f"with v as (select vec_id // {TERMS} as doc_id, vec_id % {TERMS} as rank, cast(vec_id as varchar) as term, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings) select * from (select x.doc_id, x.term as a, y.term as b, round(list_dot_product(x.e, y.e), 6) as similarity from v x join v y on x.doc_id = y.doc_id and x.rank < y.rank where list_dot_product(x.e, y.e) >= 0.35)",
        "contexts": f"with {aug}, {Q.TOKENS} select t.doc_id, t.text as term, start, {snip('doc.text', 'start', 'stop')} as context from tok t join doc on doc.doc_id = t.doc_id where {Q.m('t.text', '^[A-Z]{2,8}' + chr(92) + 'z')}",
        "term_occurrences": f"""with {aug}, {Q.TOKENS}, term as (select unnest(['audit committee', 'de la']) as term), many as (select doc_id, text, term from doc, term where contains(lower(text), term)),
            hit as ({Q.matches('many', 'text', "'(?i)" + chr(92) + "b' || term || '" + chr(92) + "b'", 'doc_id, term')}) select doc_id, term, count(*) as n, cast(sum(start) as bigint) as starts from (select doc_id, 'the' as term, start from tok where lower = 'the' union all select doc_id, term, start from hit) group by 1, 2""",
        "finding_contexts": f"{Q.union()}, {Q.OCCURRENCES} select doc_id, category, key, summary, array_to_string(contexts, chr(10)) as contexts, shown, total, cast(greatest(total - {P.SHOWN}, 0) as int) as more from item",
        "markdown_report": f"{Q.union()}, {Q.OCCURRENCES}, {Q.MARKDOWN}",
        "html_report": f"{Q.union()}, {Q.OCCURRENCES}, {Q.html('January 1, 2026')}",
        "audit_abstracts": Q.audit(f"select doc_id, abstract, found, bounded, cast(words_ as int) as words from ({Q.ABSTRACTS})"),
        "audit_references": Q.audit("select doc_id, ref_no, id, raw, record_ids, doi, year, title, array_to_string(authors, '; ') as authors, is_institutional, journal, publisher, volume, issue, pages, article_number, parsed from ref", Q.REFERENCES),
        "audit_duplicates": Q.audit("""select doc_id, "group", array_to_string(ids, ',') as ids, extra from dup""", Q.REFERENCES),
        "audit_citations": Q.audit("select doc_id, cast(rec_no as int) as rec_no, id, raw, parent_raw, author, second, year, et_al, number, last, n, status, case when status = 'matched' then fit[1] end as ref_id, array_to_string(candidates, ',') as candidates from res", Q.CITATIONS),
        "audit_issues": Q.audit('select doc_id, rule, spot, id, kind, section, review, problem, action, array_to_string(evidence, chr(124)) as evidence, array_to_string(examples, chr(124)) as examples, correction from iss', Q.issues()),
        "audit_issue_numbering": Q.audit('select doc_id, id, section, cast(dense_rank() over (partition by doc_id order by section) as int) as "group", cast(row_number() over (partition by doc_id order by section, rule, spot, id) as int) as number from iss', Q.issues()),
        "audit_comments": Q.audit("""select doc_id, pid as paragraph_id, cast(row_number() over (partition by doc_id order by rec_no) - 1 as int) as comment_id, text from (select n.doc_id, n.pid, z.rec_no, string_agg(t, chr(10) order by number) as text from (select doc_id, problem || ' ' || action as t, coalesce(string_split(evidence[1], '=')[1], 'P0001') as pid, row_number() over (partition by doc_id order by section, rule, spot, id) as number from iss) n join z on z.doc_id = n.doc_id and z.id = n.pid group by 1, 2, 3)""", Q.issues()),
        "audit_verification": Q.audit(f"select doc_id, id, status, checked, lookup, doi, identity, differences, missing, {Q.REASON} as reason from ver", Q.VERIFICATION),
        "audit_verification_issues": Q.audit(f'select doc_id, 4 as section, spot, ref, kind, correction from ({Q.VERIFIED_ISSUES})', Q.VERIFICATION),
        "audit_manual": Q.audit("select doc_id, item, case item when 2 then 'section or comment missing' when 5 then 'no quotation' when 6 then 'quotation not in its paragraph' else case when normal = '' then 'quotation not in its paragraph' when item = 3 then 'unknown DOI' when item = 4 then 'claims verification' end end as error from z, (select unnest(range(1, 7))::int as item) where rec_no = 1"),
        "audit_summary": Q.audit(f"""select t.doc_id, t.total as words, case when ab.found and ab.bounded and ab.norm_ <> '' then ab.words else -1 end as abstract_words, rf as reference_found, coalesce(r.n, 0) as "references", coalesce(r.uncited, 0) as uncited, coalesce(r.open_, 0) as open_references,
            coalesce(c.n, 0)::bigint as citations, coalesce(c.unmatched, 0) as unmatched, coalesce(c.unresolved, 0)::bigint as unresolved, coalesce(d.extra, 0)::bigint as duplicates, coalesce(v.n, 0) as verified, coalesce(i.fix, 0)::bigint as corrections, coalesce(i.look, 0)::bigint as reviews, 0::bigint as excluded
            from total_ t left join ab on ab.doc_id = t.doc_id left join (select doc_id, bool_or(rs is not null) as rf from z group by 1) z on z.doc_id = t.doc_id
            left join (select r.doc_id, count(*) as n, count(*) filter (parsed and not used and not meant) as uncited, count(*) filter (not parsed or (not used and meant)) as open_ from (select r.doc_id, r.parsed, exists (select 1 from res where res.doc_id = r.doc_id and status = 'matched' and fit[1] = r.id) as used, exists (select 1 from res where res.doc_id = r.doc_id and list_contains(candidates, r.id)) as meant from ref r) r group by 1) r on r.doc_id = t.doc_id
            left join (select doc_id, sum(n) as n, count(*) filter (status = 'nomatch') as unmatched, coalesce(sum(n) filter (status in ('ambiguous', 'review', 'numeric_style')), 0) as unresolved from res group by 1) c on c.doc_id = t.doc_id
            left join (select doc_id, sum(extra) as extra from dup group by 1) d on d.doc_id = t.doc_id left join (select doc_id, count(*) as n from ver where status = 'metadata_verified' group by 1) v on v.doc_id = t.doc_id
            left join (select doc_id, count(*) filter (not review) as fix, count(*) filter (review) as look from (select doc_id, review from iss union all select doc_id, false from ({Q.VERIFIED_ISSUES})) group by 1) i on i.doc_id = t.doc_id""", Q.issues() + Q.VERIFICATION.removeprefix(Q.CITATIONS)),
        "audit_words": Q.audit(f"select doc_id, cast(sum({Q.words('text')}) as bigint) as main, cast(0 as bigint) as extra, cast(sum({Q.words('text')}) as bigint) as total from z group by doc_id"),
        "audit_zones": Q.audit("select doc_id, id, section, in_abstract, in_references, in_article, bounded as abstract_bounded from z"),
        "audit_reference_islands": Q.audit("select doc_id, ref_no, id, raw, record_ids from entry"),
        "audit_captions": Q.audit("select doc_id, id, type, digits from cap"),
        "audit_callouts": Q.audit(
            "select doc_id, 'callout-' || type || '-' || digits as id from cap c where not exists (select 1 from z where z.doc_id = c.doc_id and in_article and not exists (select 1 from cap k where k.doc_id = z.doc_id and k.rec_no = z.rec_no)"
            f" and list_contains(regexp_extract_all(z.text, case when c.type = 'Table' then {Q.q(Q.re2(U.CALLOUTS['Table']).replace('(?!' + chr(92) + 'd)', ''))} else {Q.q(Q.re2(U.CALLOUTS['Figure']).replace('(?!' + chr(92) + 'd)', ''))} end, 1), c.digits))"
        ),
        "audit_caption_numbers": Q.audit("select doc_id, 'caption-duplicate-' || type as id from cap group by doc_id, type having count(*) > count(distinct digits) union all select doc_id, 'caption-sequence-' || type from cap group by doc_id, type having max(lpad(digits, 60, '0')) <> lpad(cast(count(distinct digits) as varchar), 60, '0') or min(lpad(digits, 60, '0')) <> lpad('1', 60, '0')"),
        "audit_placeholders": Q.audit(f"select doc_id, 'placeholder-' || id as id, array_to_string(regexp_extract_all(normal, {Q.q(Q.re2(U.PLACEHOLDER))}, 1), '|') as examples from z where {Q.m('normal', Q.re2(U.PLACEHOLDER))}"),
        "audit_blank_dates": Q.audit(f"select doc_id, 'blank-date-' || id as id from z where {Q.m('normal', rf'(?i)\b(?:Received|Revised|Accepted)[{T.WS}]*:[{T.WS}]*(?:(?:[;|][{T.WS}]*)?(?:Received|Revised|Accepted)\b|[;|]?[{T.WS}]*\z)')}"),
        "audit_length_rules": Q.audit(
            "select doc_id, 'manuscript-length' as id from z group by doc_id having sum(" + Q.words("text") + ") > 300 union all "
            "select doc_id, 'abstract-length' from (select doc_id, sum(case when heading = 'abstract' and rec_no = first_no then " + Q.words("regexp_replace(title, " + Q.q(Q.re2(R.HEADINGS[0][1])) + ", '')") + " else " + Q.words("text") + " end) as n from (select *, min(rec_no) over (partition by doc_id) as first_no from z where in_abstract and bounded) group by doc_id) where n > 4"
        ),
    }
    return out | {f"fuzzy_s{s}": Q.detector("fuzzy", sensitivity=s) for s in D.SENSITIVITY}
