"""The nine terminology detectors.

Each returns variant rows (doc_id, category, key, form, n, first_start, words): one form of one
finding, with its count, the place that orders it among the finding's forms, and the lower-case
words whose tokens are its occurrences (or null). `findings` gathers them with occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import tokens as K

#: Sensitivity -> (edit distance, most occurrences of the rarer word).
SENSITIVITY = {0: (1, 2), 1: (2, 3), 2: (3, 6)}
ARROW = "  \u2192  "


def _variants(df: DataFrame, category: str, key: str, form, n, first: str) -> DataFrame:
    return df.select("doc_id", F.lit(category).alias("category"), F.col(key).alias("key"), (form if isinstance(form, Column) else F.col(form)).alias("form"), (n if isinstance(n, Column) else F.col(n)).cast("long").alias("n"), F.col(first).cast("long").alias("first_start"))


def _having(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Rows of the groups that meet all conditions, each an aggregate over the group."""
    w = W.partitionBy(*keys)
    df = df.withColumns({name: c.over(w) for name, c in conditions.items()})
    for name in conditions:
        df = df.where(F.col(name) > 1)
    return df.drop(*conditions)


def case(toks: DataFrame) -> DataFrame:
    """Words with several spellings by case away from sentence starts."""
    words = K.forms(toks).where((F.col("n_usable") > 0) & (F.length("lower") >= 3) & F.col("lower").rlike("[a-zA-Z]") & ~F.col("lower").rlike("[0-9_-]"))
    forms = words.select("doc_id", "lower", "text", F.col("n_usable").alias("n"), "interior", F.col("first_usable").alias("first"))
    return _variants(_having(forms, ["doc_id", "lower"], total=F.sum("n"), inside=F.count_if(F.col("interior") > 0)), "case", "lower", "text", "n", "first")


def hyphenation(vocab: DataFrame) -> DataFrame:
    """Words written with and without hyphen or underscore."""
    v = vocab.withColumn("key", F.regexp_replace("lower", "[-_]", "")).where(F.length("key") >= 4)
    v = v.withColumn("shape", F.when(F.col("lower").contains("_"), 4).when(F.col("lower").contains("-"), 2).otherwise(1))
    shapes = F.bit_count(F.bit_or("shape").over(W.partitionBy("doc_id", "key")))
    v = v.withColumns({"shapes": shapes, "forms": F.count("*").over(W.partitionBy("doc_id", "key"))}).where("shapes > 1 and forms > 1")
    return _variants(v, "hyphenation", "key", "lower", "n", "first_start")


def identifier(toks: DataFrame) -> DataFrame:
    """Names written in several identifier styles."""
    forms = K.forms(toks).withColumn("style", T.identifier_style(F.col("text"))).where("style is not null").withColumn("root", T.identifier_root(F.col("text"))).where(F.length("root") >= 4)
    styles = F.size(F.collect_set("style").over(W.partitionBy("doc_id", "root")))
    forms = forms.withColumn("styles", styles).where("styles > 1")
    return _variants(forms, "identifier", "root", F.concat("text", F.lit("  ("), "style", F.lit(")")), "n", "first")


def spelling(vocab: DataFrame) -> DataFrame:
    """American and British forms of one word."""
    v = vocab.where(F.col("lower").rlike(r"^[a-z]{4,}\z")).withColumn("key", T.spelling_key(F.col("lower")))
    return _variants(_having(v, ["doc_id", "key"], forms=F.count("*")), "spelling", "key", "lower", "n", "first_start")


def glossary_matches(docs: DataFrame, pairs: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """doc_id, line_no (of the glossary), preferred, alt, match, start of each use of an alternative."""
    pairs = T.glossary_pairs() if pairs is None else pairs
    docs = docs.select("doc_id", "text", F.lower("text").alias("low"))
    # one pass of the text for each alternative: gap and match alternate from the last match on
    hits = [F.struct(F.lit(k).alias("line_no"), F.lit(p).alias("preferred"), F.lit(a).alias("alt"), F.when(F.col("low").contains(a.lower()), located_matches(F.col("text"), T.term_pattern(a))).alias("m")) for k, p, a in pairs]
    out = docs.select("doc_id", F.inline(F.filter(F.array(*hits), lambda h: F.size(h.m) > 0)))
    return out.select("doc_id", "line_no", "preferred", "alt", F.inline("m"))


def located_matches(text: Column, pattern: str) -> Column:
    """(match, start) of every match of a pattern without capture groups, by one linear pass."""
    flags, body = (pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]) if pattern.startswith("(?i") else ("", pattern)
    gapped = rf"{flags}(?s:\G(.*?))({body})"
    gaps, found = (F.regexp_extract_all(text, F.lit(gapped), F.lit(k)) for k in (1, 2))
    step = lambda a, x: F.struct((a.at + F.length(x["0"]) + F.length(x["1"])).alias("at"), F.array_append(a.out, F.struct(x["1"].alias("match"), (a.at + F.length(x["0"])).alias("start"))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int>>").alias("out"))
    return F.aggregate(F.arrays_zip(gaps.alias("0"), found.alias("1")), zero, step, lambda a: a.out)


def glossary(docs: DataFrame, pairs: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """Alternatives used instead of the preferred term; the preferred term need not occur."""
    hits = glossary_matches(docs, pairs).groupBy("doc_id", "line_no", "preferred", "alt").agg(F.count("*").alias("n"))
    rows = hits.select("doc_id", "line_no", "alt", F.inline(F.array(F.struct(F.lit(0).alias("at"), F.concat("preferred", F.lit("  (preferred)")).alias("form"), F.lit(0).cast("long").alias("m")), F.struct(F.lit(1).alias("at"), F.col("alt").alias("form"), F.col("n").alias("m")))))
    return _variants(rows.withColumn("key", F.lower("alt")), "glossary", "key", "form", "m", "at")


def acronym_definitions(docs: DataFrame) -> DataFrame:
    """doc_id, acronym, full, start, end of each "Full Term (ACR)"."""
    found = docs.where(F.col("text").contains("(")).select("doc_id", F.inline(located_matches(F.col("text"), T.ACRONYM_DEFINITION.replace("((?:", "(?:(?:", 1).replace("([A-Z]{2,8})", "[A-Z]{2,8}"))))
    part = lambda k: F.regexp_extract("match", T.ACRONYM_DEFINITION, k)
    return found.select("doc_id", part(2).alias("acronym"), T.trim(part(1)).alias("full"), "start", (F.col("start") + F.length("match")).alias("end"))


def acronym(docs: DataFrame) -> DataFrame:
    """Acronyms with several definitions."""
    d = acronym_definitions(docs).groupBy("doc_id", "acronym", F.lower("full").alias("low")).agg(F.min_by("full", "start").alias("full"), F.min("start").alias("first"))
    d = _having(d, ["doc_id", "acronym"], fulls=F.count("*"))
    return _variants(d, "acronym", "acronym", F.concat("full", F.lit(ARROW), "acronym"), F.lit(0), "first")


def undefined_acronyms(toks: DataFrame, docs: DataFrame) -> DataFrame:
    """Acronyms used three times or more without a definition."""
    used = K.forms(toks).where((F.col("n") >= 3) & F.col("text").rlike(r"^[A-Z]{2,8}\z") & ~F.col("text").isin(T.KNOWN_ACRONYMS)).select("doc_id", F.col("text").alias("acronym"), "n", "first")
    used = used.join(acronym_definitions(docs).select("doc_id", "acronym"), ["doc_id", "acronym"], "left_anti").withColumn("key", F.concat("acronym", F.lit("-undefined")))
    return _variants(used, "acronym", "key", F.concat("acronym", F.lit("  (used "), "n", F.lit('\u00d7, no "(...)" definition found)')), F.lit(0), "first")


def phrase(grams: DataFrame) -> DataFrame:
    """Two-word terms written with several casings."""
    forms = K.pairs(grams).select("doc_id", F.concat_ws(" ", F.lower("w1"), F.lower("w2")).alias("key"), F.concat_ws(" ", "w1", "w2").alias("form"), "n", F.col("start").alias("first"))
    w = W.partitionBy("doc_id", "key")
    forms = forms.withColumns({"forms": F.count("*").over(w), "total": F.sum("n").over(w)}).where("forms > 1 and total >= 3")
    return _variants(forms, "phrase", "key", "form", "n", "first")


def reorder(grams: DataFrame) -> DataFrame:
    """Two-word terms whose words come in both orders."""
    a, b = F.lower("w1"), F.lower("w2")
    g = K.pairs(grams).where(a != b).select("n", "doc_id", F.concat_ws(" ", F.least(a, b), F.greatest(a, b)).alias("key"), (a < b).alias("sorted"), F.concat_ws(" ", "w1", "w2").alias("form"), "start")
    orders = g.groupBy("doc_id", "key", "sorted").agg(F.sum("n").alias("n"), F.min("start").alias("first"), F.min_by("form", "start").alias("form"))
    return _variants(_having(orders, ["doc_id", "key"], orders=F.count("*")), "reorder", "key", "form", "n", "first")


def fuzzy_pairs(vocab: DataFrame, sensitivity: int = 1) -> DataFrame:
    """doc_id, a, b, n_a, n_b, first_a, first_b: rare near-identical spellings.

    Sharing the first two and the last letter is the block key of the join, with the document.
    """
    edits, rare = SENSITIVITY.get(sensitivity, SENSITIVITY[2])
    v = vocab.where((F.col("n_usable") > 0) & F.col("lower").rlike(r"^[a-z]{6,}\z") & ~F.col("lower").isin(T.FUZZY_STOPWORDS))
    v = v.select("doc_id", F.concat(F.substring("lower", 1, 2), F.substring("lower", -1, 1)).alias("block"), F.col("lower").alias("w"), F.col("n_usable").alias("n"), F.col("first_start").alias("first"), T.strip_affixes(F.col("lower")).alias("stem"), T.spelling_key(F.col("lower")).alias("key")).persist()  # both sides read it
    side = lambda x: v.select("doc_id", "block", *(F.col(c).alias(f"{c}_{x}") for c in ("w", "n", "first", "stem", "key")))
    apart = F.levenshtein("w_a", "w_b", edits + 1)
    near = (F.col("first_a") < F.col("first_b")) & (F.abs(F.length("w_a") - F.length("w_b")) <= edits) & (F.least("n_a", "n_b") <= rare) & (F.col("stem_a") != F.col("stem_b")) & (F.col("key_a") != F.col("key_b"))
    near = near & (apart > 0) & (apart <= F.when(F.length("w_a") > 8, edits + 1).otherwise(edits))
    return side("a").join(side("b"), ["doc_id", "block"]).where(near).select("doc_id", F.col("w_a").alias("a"), F.col("w_b").alias("b"), "n_a", "n_b", "first_a", "first_b")


def fuzzy(vocab: DataFrame, sensitivity: int = 1) -> DataFrame:
    p = fuzzy_pairs(vocab, sensitivity).withColumn("key", F.concat_ws("~", F.least("a", "b"), F.greatest("a", "b")))
    rows = p.select("doc_id", "key", F.inline(F.array(F.struct(F.col("a").alias("form"), F.col("n_a").alias("n"), F.lit(0).alias("at")), F.struct(F.col("b").alias("form"), F.col("n_b").alias("n"), F.lit(1).alias("at")))))
    return _variants(rows, "fuzzy", "key", "form", "n", "at")


def all_variants(docs: DataFrame, glossary_pairs: list | None = None, check_undefined: bool = False, sensitivity: int = 1, checks: set[str] | None = None, toks: DataFrame | None = None) -> DataFrame:
    """Variant rows of all detectors (or of the named ones) for documents (doc_id, text).

    Null texts have no findings; documents need distinct ids; other columns are ignored. toks is the
    documents' token layer where the caller has one. What several detectors read is persisted until
    the session's cache is cleared.
    """
    raw = K.plain(docs)  # patterns of the raw text need no shuffle of it
    if toks is None:
        # several detectors read them; a lost part is made again
        toks = K.tokens(raw, keep=checks is None or len(checks & {"case", "hyphenation", "identifier", "spelling", "acronym", "phrase", "reorder", "fuzzy"}) > 1)
    grams = K.bigrams(toks)
    if checks is None:  # counted once; a plan that counts the same again reads these
        toks, grams = K.forms(toks).persist(), K.pairs(grams).persist()
        if check_undefined:
            acronym_definitions(raw).persist()
    vocab = K.vocabulary(toks)
    made = {
        "case": lambda: case(toks),
        "hyphenation": lambda: hyphenation(vocab),
        "identifier": lambda: identifier(toks),
        "spelling": lambda: spelling(vocab),
        "glossary": lambda: glossary(raw, glossary_pairs),
        "acronym": lambda: acronym(raw).unionByName(undefined_acronyms(toks, raw)) if check_undefined else acronym(raw),
        "phrase": lambda: phrase(grams),
        "reorder": lambda: reorder(grams),
        "fuzzy": lambda: fuzzy(vocab, sensitivity),
    }
    out = None
    for name, make in made.items():
        if checks is None or name in checks:
            out = make() if out is None else out.unionByName(make())
    return out


def occurrences(docs: DataFrame, variants: DataFrame, glossary_pairs: list | None = None, toks: DataFrame | None = None) -> DataFrame:
    """doc_id, category, key, text, start, end of what each finding points at."""
    raw = K.plain(docs)
    toks = K.tokens(K.plain(docs), keep=True) if toks is None else toks
    grams = K.bigrams(toks)
    keys = lambda *names: variants.where(F.col("category").isin(*names)).select("doc_id", "category", "key").distinct()
    out = ["doc_id", "category", "key", "text", "start", "end"]
    # whole tokens, by one join: their lower-case word, and the exact form where case matters
    forms = variants.where(F.col("category").isin("hyphenation", "spelling", "fuzzy", "identifier", "case") | ((F.col("category") == "acronym") & F.col("key").endswith("-undefined")))
    exact = F.when(F.col("category") == "identifier", F.substring_index("form", "  (", 1)).when(F.col("category") == "acronym", F.substring_index("key", "-undefined", 1))
    forms = forms.select("doc_id", "category", "key", exact.alias("exact"), F.lower(F.coalesce(exact, "form")).alias("lower")).distinct()
    of_tokens = forms.join(toks, ["doc_id", "lower"]).where("(exact is null or exact = text) and (usable or category not in ('fuzzy', 'case'))").select(out)
    defined = keys("acronym").join(acronym_definitions(raw).withColumnRenamed("acronym", "key"), ["doc_id", "key"]).withColumn("text", F.col("key")).select(out)
    # two words, by one join: in order of the alphabet, and in their own order where that matters
    a, b = F.lower("w1"), F.lower("w2")
    two = grams.select("doc_id", F.concat_ws(" ", "w1", "w2").alias("text"), "start", "end", F.concat_ws(" ", a, b).alias("ordered"), F.concat_ws(" ", F.least(a, b), F.greatest(a, b)).alias("bag"), (a != b).alias("differ"))
    pairs = keys("phrase", "reorder").withColumn("bag", F.array_join(F.sort_array(F.split("key", " ")), " "))
    of_pairs = pairs.join(two, ["doc_id", "bag"]).where("case when category = 'phrase' then ordered = key else differ end").select(out)
    terms = keys("glossary").join(glossary_matches(raw, glossary_pairs).select("doc_id", F.lower("alt").alias("key"), F.col("match").alias("text"), "start", (F.col("start") + F.length("match")).alias("end")), ["doc_id", "key"]).select(out)
    return of_tokens.unionByName(defined).unionByName(of_pairs).unionByName(terms)


def findings(docs: DataFrame, **options) -> DataFrame:
    """doc_id, category, key, variants (form, count) and occurrences (text, start, end) of every finding."""
    toks = K.tokens(K.plain(docs), keep=True)  # one token layer for forms and places
    rows = all_variants(docs, **options, toks=toks).persist()  # variants and occurrences both read it
    v = rows.groupBy("doc_id", "category", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("first_start", "form", "n"))), lambda x: F.struct(x.form.alias("form"), x.n.alias("count"))).alias("variants"))
    o = occurrences(docs, rows, options.get("glossary_pairs"), toks).groupBy("doc_id", "category", "key").agg(F.transform(F.sort_array(F.collect_set(F.struct("start", "end", "text"))), lambda x: F.struct(x.text.alias("text"), x.start.alias("start"), x.end.alias("end"))).alias("occurrences"))
    return v.join(o, ["doc_id", "category", "key"], "left")
