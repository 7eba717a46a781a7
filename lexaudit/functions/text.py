"""Patterns and scalar functions of the text checks, as column expressions.

Patterns are written so that Java's and RE2's engines read them alike: white space is one explicit
class (Java's \\s lacks the no-break space), ends are \\z, and ASCII word edges are spelled out where
lookaround is needed. Offsets and lengths count code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character classes, patterns and word lists that decide results
WS = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same characters, one by one.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{WS}]", c))
TOKEN = r"[\p{L}\p{N}_-]+"
NOT_TOKEN = r"[^\p{L}\p{N}_-]+"
#: Characters that may stand between a boundary and a word, but for `-` and `_`, which are token characters.
DECORATION = "*#>\"'\u201c\u201d\u2018\u2019()\\[\\]+=~|"
HEADING_LINE = rf"(?i)^[{WS}]*(?:\d+\.?\d*\.?[{WS}]*)?(abstract|introduction|literature review|related work|methods?|methodology|materials? and methods?|results?([{WS}]+and[{WS}]+discussion)?|discussion|conclusions?|recommendations?|references|bibliography|acknowledge?ments?|appendix(es)?|keywords?)[{WS}]*[:.]?[{WS}]*\z"
CAPTION_LINE = rf"(?i)^(table|figure|fig\.)[{WS}]*\d+"
REFERENCES_LINE = r"(?i)^(references|bibliography|works cited|list of references)\z"
LONGEST_HEADING = 100
FUZZY_STOPWORDS = (
    "through throughout although because without within between before unless during should would could their there these"
    " those where while which whose being having around across toward towards beyond behind beneath regarding concerning despite whereas"
    " whenever wherever whatever however moreover therefore further furthermore nevertheless nonetheless itself himself herself themselves ourselves"
).split()
PHRASE_STOPWORDS = (
    "the a an of in on at to as by for and or but is are was were be been being this that these those"
    " with from its their our we they he she it not no between within without under over about after before during"
    " through into onto upon across among against toward towards since until per via than then so such also both each"
    " has have had does do did will would can could should must"
).split()
CANDIDATE_STOPWORDS = (
    "the and for are but not this that these those with from have has had was were been being will would could should"
    " which while where when what their there about into onto https http www doi anchor ref"
    " yang dan atau dari pada untuk dengan adalah akan tidak juga oleh sebagai dapat telah para suatu sebuah ini itu karena namun"
    " serta antara terhadap dalam seperti sangat lebih hanya masih sudah"
).split()
KNOWN_ACRONYMS = ["US", "UK", "USA", "UN", "EU"]
SPELLING_RULES = [
    (r"our\z", "or"),
    (r"is(e|ed|es|ing|er|ers|ation|ations|able)\z", "iz$1"),
    (r"([bcdfgklmnprstvz])re\z", "$1er"),
    ("ae", "e"),
    ("oe", "e"),
    (r"ll(ed|er|ing|ers)\z", "l$1"),
    (r"nce\z", "nse"),
]
SUFFIXES = "ications ication ational ization fulness ousness iveness ing edly tion sion ment ness able ible ally ed es ly er or al ic ty ive s".split()
PREFIXES = "non pre post anti inter super under over semi multi micro macro mis dis un re sub".split()
ACRONYM_DEFINITION = rf"((?:[A-Z][a-zA-Z]+[{WS}]+){{1,6}})\(([A-Z]{{2,8}})\)"
TITLE_PHRASE = r"([A-Z][a-zA-Z]+(?:[ \t]+[A-Z][a-zA-Z]+){1,3})"
GLOSSARY = """dataset, data set
website, web site
email, e-mail
online, on-line
login, log in
logout, log out
setup, set up
follow-up, follow up, followup
real-time, real time
healthcare, health care
peer review, peer-review
case study, case-study
long-term, long term
short-term, short term
well-known, well known
state-of-the-art, state of the art
open-source, open source
cross-sectional, cross sectional
p-value, p value
sample size, sample-size
subgroup, sub-group
preprocessing, pre-processing
postprocessing, post-processing
overfitting, over-fitting
underfitting, under-fitting
nonlinear, non-linear
multidisciplinary, multi-disciplinary
baseline, base line
worldwide, world-wide
lifecycle, life cycle
coworker, co-worker"""


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def escape_html(c: Column | str) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c if isinstance(c, Column) else F.col(c), F.lit(a), F.lit(b))
    return c


def identifier_style(c: Column) -> Column:
    """snake_case, kebab-case, PascalCase, camelCase or null."""
    return (
        F.when(c.contains("_"), "snake_case")
        .when(c.contains("-") & c.rlike("[A-Za-z]"), "kebab-case")
        .when(c.rlike("^[A-Z]") & c.rlike("[a-z]") & c.rlike("^.[\\s\\S]*[A-Z]"), "PascalCase")
        .when(c.rlike(r"^[a-z][a-zA-Z0-9]*\z") & c.rlike("[A-Z]"), "camelCase")
    )


def identifier_root(c: Column) -> Column:
    """Lower case without separators; they become blanks first, which decides how a final sigma lowers."""
    return F.replace(F.lower(F.regexp_replace(c, "[_-]+", " ")), F.lit(" "), F.lit(""))


def spelling_key(c: Column) -> Column:
    low = F.lower(c)
    key = low
    for pattern, to in SPELLING_RULES:
        key = F.regexp_replace(key, pattern, to)
    return F.when(F.length(low) < 4, low).otherwise(key)


def strip_affixes(c: Column) -> Column:
    """The first suffix, then the first prefix, whose removal leaves three characters or more.

    In both lists an affix stands before those it ends (or begins) with, so the patterns, which try
    the longest suffix first and prefixes in order, find the same one.
    """
    stem = F.regexp_replace(F.lower(c), rf"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})\z", "$1")
    return F.regexp_replace(stem, rf"^(?:{'|'.join(PREFIXES)})(.{{3,}})\z", "$1")


def line_core(line: Column) -> Column:
    return F.btrim(F.translate(line, "*_#>", ""), F.lit(BLANKS))


def line_excluded(line: Column, core: Column | None = None) -> Column:
    """Table rows, headings, all-capital labels, bold lines and captions: structure, not prose. core is the line's `line_core` where the caller has it."""
    core = line_core(line) if core is None else core
    capitals = core.rlike("[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]") & ~core.rlike("[a-z]")
    heading = line.rlike(rf"^[{WS}]*\*\*.+\*\*[{WS}]*\z") | capitals | core.rlike(HEADING_LINE) | core.rlike(CAPTION_LINE)
    return (F.substring_index(line, "|", 2) != line) | ((core != "") & (F.length(core) <= LONGEST_HEADING) & heading)


def references_line(line: Column, core: Column | None = None) -> Column:
    return (line_core(line) if core is None else core).rlike(REFERENCES_LINE)


def term_pattern(term: str) -> str:
    """A term between ASCII word edges, any case."""
    edge = lambda ch, behind: r"(?<![A-Za-z0-9_])" if behind and re.match(r"\w", ch, re.A) else r"(?<=[A-Za-z0-9_])" if behind else r"(?![A-Za-z0-9_])" if re.match(r"\w", ch, re.A) else r"(?=[A-Za-z0-9_])"
    return f"(?iu){edge(term[0], True)}{re.sub(r'([.*+?^${}()|[\]\\])', r'\\\1', term)}{edge(term[-1], False)}"


def snippet(text: Column, start: Column, end: Column, span: int = 45) -> Column:
    """The surroundings of [start, end), white space collapsed, with an ellipsis where text is cut off."""
    a, b = F.greatest(start - span, F.lit(0)), F.least(end + span, F.length(text))
    mid = trim(F.regexp_replace(F.substr(text, (a + 1).cast("int"), (b - a).cast("int")), f"[{WS}]+", " "))
    return F.concat(F.when(a > 0, "…").otherwise(""), mid, F.when(b < F.length(text), "…").otherwise(""))


def glossary_pairs(lines: str | list[str] = GLOSSARY) -> list[tuple[int, str, str]]:
    """(line number, preferred, alternative) of each alternative."""
    out = []
    for k, line in enumerate(lines.split("\n") if isinstance(lines, str) else lines):
        parts = [p for p in (x.strip() for x in line.split(",")) if p]
        out += [(k, parts[0], alt) for alt in parts[1:]]
    return out
