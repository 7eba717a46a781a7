"""The queries in DuckDB's SQL, built from common table expressions."""

from __future__ import annotations

import re

from ..functions import text as T
from ..operators import detectors as D
from ..operators import report as P
from ..operators import tokens as K
from ..operators.audit import labels as L
from ..operators.audit import records as R
from ..operators.audit import references as C
from ..operators.audit import rules as U


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(xs: list[str]) -> str:
    return "(" + ", ".join(map(q, xs)) + ")"


#: Added to documents, by id, where the corpus has no case of what a query looks for.
FIXTURES = [
    "Reply by e-mail, or write an email to the desk. Capital Adequacy Ratio (CAR) rose in spring. The Council of Auditors Register (CAR) did not.\nTheir ledgers were consistant all year; a second audit found them consistent.",
    "The form asks for clientId, its table stores client_id and the log prints ClientID. Our website is new, yet the old web site stays, and the data set grows long term.",
    "Internal Control matters here. Good Internal Control lowers risk, and Internal Control is cheap.\nThe Review Board met on Monday. On Friday the review board met once more, as the review board does, while members of the Review Board signed, and the board review ended.",
    "A Dashboard opens first. Close the dashboard to go on, because the Dashboard hides the rest.\n**Results and Discussion**\nThey organise labour and colour charts, then organize labor and color prints.\n\n# REFERENCES\n\nDoe, A. (2018). Internal Control And Firm Size. Review of Ledgers, 3(1), 7-19.",
]
#: Lines of a manuscript, added to documents for the audit.
MANUSCRIPT = [
    "Abstract: This study examines audit quality.\nKeywords: audit, quality\n1. Introduction\nTable 1 shows the sample (Smith, 2020).\nTable 1 Sample\nTable 3 Results\n[INSERT TITLE] goes here, TODO\nReceived: ; Accepted:\nSmith and Doe, 2019 and Lee et al (2019) and Roe & Poe (2018) agree, see [12345678901234567890123], [7-9] and [3-2].\nThe Board of Ledgers (BOL, 2017) did not. BOL (2017) and Smith (2020) differ.\nReferences\nSmith, J. (2020). Audit quality. Journal A, 5(2), 1-20.\nhttps://doi.org/10.1000/abc\nSmith, J. (2020). Audit quality. Journal A, 5(2), 1-20. https://doi.org/10.1000/abc\nBoard of Ledgers. (2017). Rules for ledgers. Press House.\nAppendix A\nExtra material.",
    "Abstract\nA longer text on several lines.\nIntroduction\nAs Figure 2 and Tables 4 show (see Lee et al., 2019; Ortiz & Park, 2021a).\nFigure 2. Trend\nFigure 2 Trend again\nDaftar Pustaka\n1. Lee, A. B., Kim, C., & Roe, D. (2019). Firm value. Review, 12(1), 33-48.\n2. Ortiz, P., & Park, Q. (2021a). Board size. Press House.\n[3] Unparsed entry\nAcknowledgements\nThanks.",
    "Results and Discussion\nNothing here cites anything [1, 3-4].\nFig. 1 Map\nTable 0002 Long 1\nTable 99999999999999999999999999999999999999999 Too long\nConclusion\nDone.",
]


def _added(texts: list[str], gap: str) -> str:
    return f"coalesce(text, '') || {q(gap)} || case doc_id % {len(texts)} " + " ".join(f"when {k} then {q(t)}" for k, t in enumerate(texts)) + " end"


PLAIN = "doc as (select doc_id, coalesce(text, '') as text from documents)"
AUGMENTED = f"doc as (select doc_id, {_added(FIXTURES, chr(10) * 2)} as text from documents)"
RECORDS = f"doc as (select doc_id, {_added(MANUSCRIPT, chr(10))} as text from documents)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{T.WS}]+|[{T.WS}]+' + chr(92) + 'z')}, '', 'g')"


def snippet(t: str, a: str, b: str) -> str:
    cut = f"substr({t}, greatest({a} - 45, 0) + 1, least({b} + 45, length({t})) - greatest({a} - 45, 0))"
    mid = trim(f"regexp_replace({cut}, {q(f'[{T.WS}]+')}, chr(32), 'g')")
    return f"(case when greatest({a} - 45, 0) > 0 then '…' else '' end) || {mid} || (case when least({b} + 45, length({t})) < length({t}) then '…' else '' end)"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '^0+(\\d)', '\\1')"


def core(x: str) -> str:
    return trim(f"regexp_replace({x}, '[*_#>]', '', 'g')")


def m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


LINES = f"""
parts as (select doc_id, string_split(text, chr(10)) as p, string_split(chr(1) || regexp_replace(translate(text, chr(1), chr(2)), {q(K.BOUNDARY)}, '\\0' || chr(1), 'g'), chr(10)) as mk from doc),
raw as (select doc_id, unnest(range(len(p))) as line_no, unnest(p) as line, unnest(mk) as marked from parts),
cored as (select *, {core('line')} as core, regexp_replace({core('line')}, '[^A-Za-z]', '', 'g') as letters from raw),
ref as (select doc_id, min(line_no) as r from cored where {m('core', T.REFERENCES_LINE)} group by doc_id),
line as (select c.doc_id, line_no, line, marked,
    {m('line', r'\|[^|]*\|')} or (core <> '' and length(core) <= {T.LONGEST_HEADING} and ({m(trim('line'), r'^\*\*.+\*\*\z')} or (length(letters) >= 3 and letters = upper(letters)) or {m('core', T.HEADING_LINE)} or {m('core', T.CAPTION_LINE)})) as excluded,
    coalesce(line_no >= r, false) as after_refs from cored c left join ref on ref.doc_id = c.doc_id)"""

TOKENS = f"""{LINES},
seg0 as (select doc_id, line_no, not excluded and not after_refs as usable, regexp_extract_all(marked, {q(T.TOKEN + '|' + T.NOT_TOKEN)}) as s from line),
seg1 as (select doc_id, line_no, usable, unnest(range(len(s))) as k, unnest(s) as seg from seg0),
seg2 as (select *, {m('seg', '^' + T.TOKEN)} as is_token, length(replace(seg, chr(1), '')) as size, string_split(seg, chr(1))[-1] as tail from seg1),
seg3 as (select *, case when is_token then case when {m('seg', '[^_-]')} then false end when not {m('tail', f'^[{T.DECORATION}{T.WS}]*' + chr(92) + 'z')} then false when contains(seg, chr(1)) then true end as state from seg2),
seg4 as (select *, coalesce(sum(size) over w, 0) + line_no as start, coalesce(last_value(state ignore nulls) over w, false) as boundary from seg3 window w as (partition by doc_id order by line_no, k rows between unbounded preceding and 1 preceding)),
tok as (select doc_id, line_no, seg as text, lower(seg) as lower, cast(start as int) as start, cast(start + size as int) as stop, usable, boundary from seg4 where is_token)"""

VOCAB = f"""{TOKENS},
vocab as (select doc_id, lower, count(*) as n, count(*) filter (usable) as n_usable, min(start) as first_start from tok group by doc_id, lower)"""

GRAMS = f"""{TOKENS},
two as (select doc_id, text as w1, start, stop, usable, lead(text) over w as w2, lead(start) over w as start2, lead(stop) over w as stop2, lead(usable) over w as usable2 from tok window w as (partition by doc_id order by start)),
gram as (select doc_id, w1, w2, start, stop2 as stop from two where usable and usable2 and start2 - stop = 1 and {m('w1', '^[a-zA-Z]{3,}' + chr(92) + 'z')} and {m('w2', '^[a-zA-Z]{3,}' + chr(92) + 'z')} and lower(w1) not in {names(T.PHRASE_STOPWORDS)} and lower(w2) not in {names(T.PHRASE_STOPWORDS)})"""


def spelling_key(x: str) -> str:
    out = x
    for pattern, to in T.SPELLING_RULES:
        out = f"regexp_replace({out}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"
    return f"case when length({x}) < 4 then {x} else {out} end"


def affixes(x: str) -> str:
    s = "case " + " ".join(f"when {x} like '%{p}' and length({x}) - {len(p)} >= 3 then {x}[1 : length({x}) - {len(p)}]" for p in T.SUFFIXES) + f" else {x} end"
    return f"(select case " + " ".join(f"when s like '{p}%' and length(s) - {len(p)} >= 3 then s[{len(p)} + 1 :]" for p in T.PREFIXES) + f" else s end from (select {s} as s))"


STYLE = f"case when contains(text, '_') then 'snake_case' when contains(text, '-') and {m('text', '[A-Za-z]')} then 'kebab-case' when {m('text', '^[A-Z]')} and {m('text', '[a-z]')} and {m('text', '(?s)^..*[A-Z]')} then 'PascalCase' when {m('text', '^[a-z][a-zA-Z0-9]*' + chr(92) + 'z')} and {m('text', '[A-Z]')} then 'camelCase' end"
ROOT = "replace(lower(regexp_replace(text, '[_-]+', ' ', 'g')), ' ', '')"

DEFINITIONS = f"""
def0 as (select doc_id, regexp_extract_all(text, {q(T.ACRONYM_DEFINITION)}, 1) as f, regexp_extract_all(text, {q(T.ACRONYM_DEFINITION)}, 2) as a from doc where contains(text, '(')),
def1 as (select doc_id, unnest(range(len(f))) as k, {trim('unnest(f)')} as full_, unnest(a) as acronym from def0)"""


def _detector(name: str, sensitivity: int = 1) -> tuple[str, str]:
    """(common table expressions needed, select of doc_id, category, key, form, n, and f to order a key's forms by)."""
    if name == "case":
        return TOKENS, f"select doc_id, 'case' as category, lower as key, text as form, n, f from (select *, sum(n) over g as total, count(*) filter (interior > 0) over g as inside from (select doc_id, lower, text, min(start) as f, count(*) as n, count(*) filter (not boundary) as interior from tok where usable and length(lower) >= 3 and {m('lower', '[a-zA-Z]')} and not {m('lower', '[0-9_-]')} group by 1, 2, 3) window g as (partition by doc_id, lower)) where total > 1 and inside > 1"
    if name == "hyphenation":
        return VOCAB, "select doc_id, 'hyphenation' as category, key, lower as form, n, first_start as f from (select *, count(*) over g as forms, max(shape) over g <> min(shape) over g as mixed from (select *, regexp_replace(lower, '[-_]', '', 'g') as key, case when contains(lower, '_') then 2 when contains(lower, '-') then 1 else 0 end as shape from vocab) where length(key) >= 4 window g as (partition by doc_id, key)) where forms > 1 and mixed"
    if name == "identifier":
        return TOKENS, f"select doc_id, 'identifier' as category, root as key, text || '  (' || style || ')' as form, n, f from (select *, max(style) over g <> min(style) over g as mixed from (select doc_id, root, text, style, min(start) as f, count(*) as n from (select doc_id, text, start, {STYLE} as style, {ROOT} as root from tok) where style is not null and length(root) >= 4 group by 1, 2, 3, 4) window g as (partition by doc_id, root)) where mixed"
    if name == "spelling":
        return VOCAB, f"select doc_id, 'spelling' as category, key, lower as form, n, first_start as f from (select *, count(*) over (partition by doc_id, key) as forms from (select *, {spelling_key('lower')} as key from vocab where {m('lower', '^[a-z]{4,}' + chr(92) + 'z')})) where forms > 1"
    if name == "glossary":
        pairs = " union all ".join(f"select {k} as g, {q(p)} as preferred, {q(a)} as alt" for k, p, a in T.glossary_pairs())
        return f"gl as ({pairs}), hit as (select doc_id, g, preferred, alt, len(regexp_extract_all(text, '(?i)\\b' || alt || '\\b')) as n from doc, gl where contains(lower(text), alt))", "select doc_id, 'glossary' as category, alt as key, form, n, f from (select doc_id, alt, preferred || '  (preferred)' as form, 0 as n, n as uses, 0 as f from hit union all select doc_id, alt, alt, n, n, 1 from hit) where uses > 0"
    if name == "acronym":
        return DEFINITIONS, f"select doc_id, 'acronym' as category, acronym as key, full_ || {q(D.ARROW)} || acronym as form, 0 as n, f from (select *, count(*) over (partition by doc_id, acronym) as fulls from (select doc_id, acronym, lower(full_) as low, arg_min(full_, k) as full_, min(k) as f from def1 group by 1, 2, 3)) where fulls > 1"
    if name == "undefined":
        return f"{TOKENS}, {DEFINITIONS}", f"select doc_id, 'acronym' as category, text || '-undefined' as key, text || '  (used ' || n || {q(chr(215) + ', no ' + chr(34) + '(...)' + chr(34) + ' definition found)')} as form, 0 as n, f from (select doc_id, text, count(*) as n, min(start) as f from tok t where {m('text', '^[A-Z]{2,8}' + chr(92) + 'z')} and text not in {names(T.KNOWN_ACRONYMS)} group by 1, 2 having count(*) >= 3) u where not exists (select 1 from def1 where def1.doc_id = u.doc_id and acronym = u.text)"
    if name == "phrase":
        return GRAMS, "select doc_id, 'phrase' as category, key, form, n, f from (select *, count(*) over g as forms, sum(n) over g as total from (select doc_id, lower(w1) || ' ' || lower(w2) as key, w1 || ' ' || w2 as form, min(start) as f, count(*) as n from gram group by 1, 2, 3) window g as (partition by doc_id, key)) where forms > 1 and total >= 3"
    if name == "reorder":
        return GRAMS, "select doc_id, 'reorder' as category, key, form, n, f from (select *, count(*) over (partition by doc_id, key) as orders from (select doc_id, least(lower(w1), lower(w2)) || ' ' || greatest(lower(w1), lower(w2)) as key, lower(w1) < lower(w2) as o, min(start) as f, count(*) as n, arg_min(w1 || ' ' || w2, start) as form from gram where lower(w1) <> lower(w2) group by 1, 2, 3)) where orders > 1"
    edits, rare = D.SENSITIVITY[sensitivity]
    v = f"fz as (select doc_id, lower as w, n_usable as n, first_start as f, {affixes('lower')} as stem, {spelling_key('lower')} as sk, left(lower, 2) || right(lower, 1) as b from vocab where n_usable > 0 and {m('lower', '^[a-z]{6,}' + chr(92) + 'z')} and lower not in {names(T.FUZZY_STOPWORDS)}), fp as (select x.doc_id, x.w as a, y.w as b, x.n as n_a, y.n as n_b from fz x join fz y on x.doc_id = y.doc_id and x.b = y.b and x.f < y.f and abs(length(x.w) - length(y.w)) <= {edits} and least(x.n, y.n) <= {rare} and x.stem <> y.stem and x.sk <> y.sk and levenshtein(x.w, y.w) <= case when length(x.w) > 8 then {edits + 1} else {edits} end)"
    return f"{VOCAB}, {v}", "select doc_id, 'fuzzy' as category, key, form, n, f from (select doc_id, least(a, b) || '~' || greatest(a, b) as key, a as form, n_a as n, 0 as f from fp union all select doc_id, least(a, b) || '~' || greatest(a, b), b, n_b, 1 from fp)"


def detector(name: str, doc: str = PLAIN, sensitivity: int = 1) -> str:
    ctes, select = _detector(name, sensitivity)
    return f"with {doc}, {ctes} select doc_id, category, key, form, n from ({select})"


DETECTORS = ("case", "hyphenation", "identifier", "spelling", "glossary", "acronym", "undefined", "phrase", "reorder", "fuzzy")


def _merge(*parts: str) -> str:
    """Common table expressions of several detectors, each once."""
    seen: dict[str, None] = {}
    for p in parts:
        depth, last, cut = 0, 0, []
        quoted = False
        for i, ch in enumerate(p):
            if ch == "'":
                quoted = not quoted
            elif not quoted and ch in "([":
                depth += 1
            elif not quoted and ch in ")]":
                depth -= 1
            elif not quoted and ch == "," and depth == 0:
                cut.append(p[last:i])
                last = i + 1
        for one in (*cut, p[last:]):
            seen.setdefault(one.strip())
    return ", ".join(seen)


def union(doc: str = AUGMENTED) -> str:
    """CTEs with `found` (doc_id, category, key, form, n) of all detectors."""
    got = [_detector(d) for d in DETECTORS]
    return f"with {doc}, {_merge(*(c for c, _ in got))}, found as ({' union all '.join(s for _, s in got)})"


def matches(table: str, text: str, pattern: str, keys: str) -> str:
    """select of keys, match, start and stop: the matches of a pattern (SQL), by what stands between them."""
    split = f"select {keys}, regexp_split_to_array({text}, {pattern}) as g, regexp_extract_all({text}, {pattern}) as x from {table}"
    each = f"select {keys}, x, g, unnest(range(1, len(x) + 1)) as k from ({split})"
    return f"select {keys}, x[k] as match, cast(coalesce(list_sum(list_transform(g[1 : k], lambda t: length(t))), 0) + coalesce(list_sum(list_transform(x[1 : k - 1], lambda t: length(t))), 0) as int) as start from ({each})"


#: Where findings are met, and findings with a line of forms and their first snippets.
OCCURRENCES = f"""
defs as ({matches("(select * from doc where contains(text, '('))", 'text', q(T.ACRONYM_DEFINITION), 'doc_id')}),
uses as ({matches("(select d.doc_id, d.text, gl.alt from doc d join gl on contains(lower(d.text), gl.alt))", 'text', "'(?i)\\b' || alt || '\\b'", 'doc_id, alt')}),
fk as (select distinct doc_id, category, key from found),
occ as (
    select f.doc_id, f.category, f.key, t.text, t.start, t.stop from found f join tok t on t.doc_id = f.doc_id and t.lower = f.form and (f.category <> 'fuzzy' or t.usable) where f.category in ('hyphenation', 'spelling', 'fuzzy')
    union all select f.doc_id, f.category, f.key, t.text, t.start, t.stop from found f join tok t on t.doc_id = f.doc_id and t.text = string_split(f.form, '  (')[1] where f.category = 'identifier'
    union all select f.doc_id, f.category, f.key, t.text, t.start, t.stop from fk f join tok t on t.doc_id = f.doc_id and t.lower = f.key and t.usable where f.category = 'case'
    union all select f.doc_id, f.category, f.key, t.text, t.start, t.stop from fk f join tok t on t.doc_id = f.doc_id and t.text || '-undefined' = f.key where f.category = 'acronym'
    union all select f.doc_id, f.category, f.key, f.key, d.start, d.start + length(d.match) from fk f join defs d on d.doc_id = f.doc_id and regexp_extract(d.match, {q(T.ACRONYM_DEFINITION)}, 2) = f.key where f.category = 'acronym'
    union all select f.doc_id, f.category, f.key, g.w1 || ' ' || g.w2, g.start, g.stop from fk f join gram g on g.doc_id = f.doc_id and lower(g.w1) || ' ' || lower(g.w2) = f.key where f.category = 'phrase'
    union all select f.doc_id, f.category, f.key, g.w1 || ' ' || g.w2, g.start, g.stop from fk f join gram g on g.doc_id = f.doc_id and lower(g.w1) <> lower(g.w2) and least(lower(g.w1), lower(g.w2)) || ' ' || greatest(lower(g.w1), lower(g.w2)) = f.key where f.category = 'reorder'
    union all select f.doc_id, f.category, f.key, u.match, u.start, u.start + length(u.match) from fk f join uses u on u.doc_id = f.doc_id and u.alt = f.key where f.category = 'glossary'),
od as (select *, row_number() over (partition by doc_id, category, key order by start, stop, text) as k from (select distinct * from occ)),
ctx as (select o.doc_id, o.category, o.key, count(*) as total, list({snippet('d.text', 'o.start', 'o.stop')} order by k) filter (k <= {P.SHOWN}) as contexts from od o join doc d on d.doc_id = o.doc_id group by 1, 2, 3),
item as (select f.doc_id, f.category, f.key, string_agg(form || case when n > 0 then ' ×' || n else '' end, ' ⇄ ' order by f, form, n) as summary, coalesce(any_value(c.contexts), []) as contexts, cast(greatest(len(coalesce(any_value(c.contexts), [])), 1) as int) as shown, cast(coalesce(any_value(c.total), 0) as int) as total
    from found f left join ctx c on c.doc_id = f.doc_id and c.category = f.category and c.key = f.key group by 1, 2, 3)"""


FLAGGED = "flagged as (select distinct doc_id, lower(string_split(string_split(form, '  (')[1], '  →')[1]) as form from found where form <> '')"


def by_category(k: int, column: str = "category") -> str:
    values = list(P.CATEGORIES.items())
    return "case " + column + " " + " ".join(f"when {q(name)} then {q(x[k]) if k >= 0 else i}" for i, (name, x) in enumerate(values)) + " end"


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


MARKDOWN = f"""
rows_ as (select doc_id, category, {by_category(-1)} as o, {by_category(0)} as title, sum(shown) as shown, count(*) as groups, string_agg('- ' || summary || coalesce(array_to_string(list_transform(contexts, lambda c: chr(10) || '  - context: ' || c), ''), ''), chr(10) order by key) as rows from item group by 1, 2),
body as (select doc_id, sum(shown) as shown, sum(groups) as groups, string_agg('## ' || title || chr(10) || rows || chr(10), chr(10) order by o) as body from rows_ group by 1)
select d.doc_id, '# Terminology Consistency Report' || chr(10) || chr(10) || 'Total occurrences: ' || cast(coalesce(shown, 0) as bigint) || chr(10) || 'Total groups: ' || cast(coalesce(groups, 0) as bigint) || chr(10) || case when body is not null then chr(10) || body else '' end as report from doc d left join body on body.doc_id = d.doc_id"""


def html(date: str) -> str:
    one = f"""'<div class="rp-issue ' || {by_category(1)} || '"><div class="t">' || {escaped('summary')} || '<span class="loc">' || shown || ' occurrence(s)</span></div>' || case when len(contexts) > 0 then '<div class="d">' || array_to_string(list_transform(contexts[1 : {P.PRINTED}], lambda c: {escaped('c')}), '<br>') || '</div>' else '' end || '</div>'"""
    row = lambda k, v: f"""'<tr><td class="k">' || {k} || '</td><td class="v">' || {v} || '</td></tr>'"""
    return f"""
    rows_ as (select doc_id, category, {by_category(-1)} as o, {escaped(by_category(0))} as title, count(*) as groups, string_agg({one}, '' order by key) as rows from item group by 1, 2),
    body as (select doc_id, sum(groups) as groups, string_agg({row('title', 'groups')}, '' order by o) as tab, string_agg('<h2>' || title || '</h2>' || rows, '' order by o) as body from rows_ group by 1)
    select d.doc_id, {q(f'<h1>Terminology Consistency Report</h1><div class="rp-meta">Generated {date}</div><div class="rp-meta">Manuscript length: ')} || len(regexp_extract_all(d.text, {q(T.TOKEN)})) || ' words</div>'
        || '<table style="margin-top:10px;"><tbody>' || {row("'Total groups flagged'", 'cast(coalesce(groups, 0) as bigint)')} || coalesce(tab, '') || '</tbody></table>' || case when body is null then {q(f'<p class="rp-empty">{P.EMPTY}</p>')} else '' end || coalesce(body, '') || {q(f'<div class="rp-foot">{P.FOOT}</div>')} as report
    from doc d left join body on body.doc_id = d.doc_id"""


def top(source: str, k: int) -> str:
    return f"select * from (select *, row_number() over (partition by doc_id order by n desc, first, term) as place from ({source})) where place <= {k}"


WORDS = f"select doc_id, lower as term, count(*) as n, min(start) as first from tok where usable and {m('lower', '^[a-z]{4,}' + chr(92) + 'z')} and lower not in {names(T.CANDIDATE_STOPWORDS)} group by 1, 2 having count(*) >= 2"
PHRASES = f"""select doc_id, arg_min(t, line_no * 1000000 + k) as term, count(*) as n, min(line_no * 1000000 + k) as first from (
    select doc_id, line_no, unnest(range(len(x))) as k, unnest(x) as t from (select doc_id, line_no, regexp_extract_all(line, {q(chr(92) + 'b' + T.TITLE_PHRASE + chr(92) + 'b')}, 1) as x from line where not excluded and not after_refs)) group by doc_id, lower(t) having count(*) >= 2"""
BIGRAMS = "select doc_id, lower(w1) || ' ' || lower(w2) as term, count(*) as n, min(start) as first from gram group by 1, 2 having count(*) >= 2"

# ---------------------------------------------------------------- the audit, on records made of lines

NORM = trim(f"regexp_replace(text, {q(f'[{T.WS}]+')}, ' ', 'g')")
WORD = f"[^{T.WS}]*[\\p{{L}}\\p{{N}}][^{T.WS}]*"


def words(x: str) -> str:
    t = f"replace({x}, chr(173), '')"
    t = f"regexp_replace(regexp_replace({t}, '(\\d)[‒–](\\d)', '\\1-\\2', 'g'), '[‒-―​]', ' ', 'g')"
    t = f"regexp_replace({t}, '([\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}])', ' \\1 ', 'g')"
    return f"len(regexp_extract_all({t}, {q(WORD)}))"


def re2(pattern: str) -> str:
    """A pattern without the lookaround that RE2 lacks, where an ASCII word edge says the same."""
    return pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")


HEADING = "case " + " ".join(f"when {m('title', re2(p))} then '{k}'" for k, p in R.HEADINGS) + " end"
AUDIT = f"""
rec0 as (select doc_id, unnest(range(1, len(p) + 1)) as rec_no, unnest(p) as text from (select doc_id, string_split(text, chr(10)) as p from doc)),
rec1 as (select *, 'P' || lpad(cast(rec_no as varchar), 4, '0') as id, {NORM} as normal from rec0),
rec2 as (select *, regexp_replace(regexp_replace(normal, {q(R.NUMBERING)}, ''), {q(f'[:.][{T.WS}]*' + chr(92) + 'z')}, '') as title from rec1),
rec3 as (select *, {HEADING} as heading from rec2),
at1 as (select doc_id, min(rec_no) filter (heading = 'references') as rs, min(rec_no) filter (heading = 'abstract') as abs_ from rec3 group by doc_id),
at2 as (select r.doc_id, any_value(rs) as rs, any_value(abs_) as abs_, min(rec_no) filter (rec_no > rs and heading <> 'references') as re, min(rec_no) filter (rec_no > abs_ and heading <> 'abstract') as ae from rec3 r join at1 on at1.doc_id = r.doc_id group by r.doc_id),
zone as (select r.*, rs, abs_, coalesce(rec_no > rs and (re is null or rec_no < re) and normal <> '', false) as in_references, coalesce(rec_no >= abs_ and (ae is null or rec_no < ae), false) as in_abstract, abs_ is not null and ae is not null as bounded, last_value(heading ignore nulls) over (partition by r.doc_id order by rec_no rows unbounded preceding) as filled from rec3 r join at2 on at2.doc_id = r.doc_id),
z as (select *, case when in_references then 'references' else coalesce(filled, 'front') end as section, not in_references and not {m('normal', R.FRONT_MATTER)} as in_article from zone),
isl as (select *, sum(case when row_number = 1 or not ({m('normal', C.CONTINUATION)} and not {m('normal', C.HAS_YEAR)}) then 1 else 0 end) over (partition by doc_id order by rec_no rows unbounded preceding) as ref_no from (select *, row_number() over (partition by doc_id order by rec_no) as row_number from z where in_references)),
entry as (select doc_id, cast(ref_no as int) as ref_no, 'R' || cast(ref_no as int) as id, string_agg(normal, ' ' order by rec_no) as raw, string_agg(id, ',' order by rec_no) as record_ids from isl group by doc_id, ref_no),
cap as (select doc_id, rec_no, id, text, case when lower(regexp_extract(normal, {q(U.CAPTION)}, 1)) in ('table', 'tabel') then 'Table' else 'Figure' end as type, {digits(f"regexp_extract(normal, {q(U.CAPTION)}, 2)")} as digits from z where {m('normal', U.CAPTION)} and not {m('normal', re2(U.REPORTING))})"""


def some(x: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def replaced(x: str, pattern: str, to: str = "", every: bool = True) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}{', ' + q('g') if every else ''})"


def flat(x: str) -> str:
    """Of texts in ASCII and accented Latin."""
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9]', '', 'g')"


HEAD = rf"^(.+?)[{T.WS}]*\(({C.YEAR})[^)]*\)\.?[{T.WS}]*"
VOLUME = rf"^(.+?),[{T.WS}]*(\d+)(?:\(([^)]+)\))?(?:,[{T.WS}]*([^.]+?))?\.?[{T.WS}]*\z"
PERSON = rf"{C.NAME}(?: {C.NAME})*,(?: ?\p{{Lu}}\.-?)+"
PLACE = r"^[\p{L}]?\d+(?:[-–][\p{L}]?\d+)?\z"
PART = rf"^[^\p{{Lu}}]*(\p{{Lu}}[^,]*?),?[{T.WS}]+({C.YEAR})"
FIRST = rf"(?:[{T.WS}]*(?:&|,)|[{T.WS}]+and[{T.WS}]|[{T.WS}]+et[{T.WS}]+al).*\z"
SECOND = rf"^[^,&]*?[{T.WS}]*(?:&|[{T.WS}]and[{T.WS}])[{T.WS}]*([^,&]+?)[{T.WS}]*\z"

REFERENCES = f"""
p1 as (select *, {replaced('raw', C.ENTRY_NUMBER, every=False)} as line, {replaced(some('raw', f'(?i)({C.DOI})', 1), '[.,;)]*' + chr(92) + 'z', every=False)} as doi from entry),
p2 as (select *, {some('line', HEAD, 2)} as year, {some('line', HEAD, 1)} as names from p1),
p3 as (select *, case when year is not null then {replaced(replaced('line', HEAD, every=False), rf'(?i)[{T.WS}]*(?:https?://(?:dx\.)?doi\.org/|doi[{T.WS}]*:[{T.WS}]*)?{C.DOI}')} end as tail from p2),
p4 as (select *, {some('tail', r'^(.+?[^.])(?:\.(?:\s|\z)|\z)', 1)} as title, {replaced('tail', r'^(.+?[^.])(?:\.\s*|\z)', every=False)} as rest from p3),
p5 as (select *, coalesce({m('names', rf'^{C.NAME}(?: {C.NAME})*, \p{{Lu}}\.')}, false) as personal, coalesce({m('rest', VOLUME)}, false) as journal_, regexp_extract(rest, {q(VOLUME)}, 4) as place from p4),
ref as (select doc_id, ref_no, id, raw, record_ids, doi, year, title,
    case when names is null then [] when personal then list_transform(regexp_extract_all(names, {q(f'({PERSON})')}, 1), lambda x: {trim('x')}) else [{replaced(trim('names'), chr(92) + '.' + chr(92) + 'z', every=False)}] end as authors, names is not null and not personal as is_institutional,
    case when journal_ then regexp_extract(rest, {q(VOLUME)}, 1) end as journal, case when not journal_ and {trim('rest')} <> '' then {replaced(trim('rest'), chr(92) + '.' + chr(92) + 'z', every=False)} end as publisher,
    case when journal_ then regexp_extract(rest, {q(VOLUME)}, 2) end as volume, case when journal_ then {some('rest', VOLUME, 3)} end as issue,
    case when journal_ and {m('place', PLACE)} then place end as pages, case when journal_ and place <> '' and not {m('place', PLACE)} then {replaced('place', '(?i)^article ', every=False)} end as article_number,
    title is not null and year is not null as parsed from p5),
dup as (select doc_id, cast(row_number() over (partition by doc_id order by first) - 1 as int) as "group", ids, n - 1 as extra from (
    select doc_id, min(ref_no) as first, list(id order by ref_no) as ids, cast(count(*) as int) as n from ref
    group by doc_id, case when doi is not null then 'doi:' || lower(doi) when parsed then 'text:' || {flat("array_to_string(authors, ' ')")} || ':' || year || ':' || {flat('title')} else 'raw:' || {flat('raw')} end) where n > 1)"""

CITATIONS = f"""{REFERENCES},
c1 as (select doc_id, rec_no, id, unnest(regexp_extract_all(text, {q(f'({C.GROUP})')}, 1)) as parent_raw from z where in_article),
c2 as (select *, unnest(string_split({replaced('parent_raw', r'^\(|\)\z')}, ';')) as part from c1),
c3 as (select doc_id, rec_no, id, {trim('part')} as raw, parent_raw, regexp_extract({trim('part')}, {q(PART)}, 1) as who, regexp_extract({trim('part')}, {q(PART)}, 2) as year from c2 where {m('part', PART)}
    union all select doc_id, rec_no, id, raw, raw, regexp_extract(raw, {q(C.NARRATIVE)}, 1), regexp_extract(raw, {q(C.NARRATIVE)}, 2) from (select doc_id, rec_no, id, unnest(regexp_extract_all(text, {q(f'({C.NARRATIVE})')}, 1)) as raw from z where in_article)),
c4 as (select *, {trim(replaced('who', FIRST, every=False))} as author, {some('who', SECOND, 1)} as second, {m('who', r'(?i)et\s+al')} as et_al, cast(null as varchar) as number, cast(null as varchar) as last, cast(1 as bigint) as n from c3),
n1 as (select doc_id, rec_no, id, unnest(regexp_extract_all(text, {q(f'({C.NUMERIC})')}, 1)) as raw from z where in_article),
n2 as (select *, regexp_extract_all(b, '(\\d+)', 1) as d from (select *, unnest(regexp_extract_all(raw, '(\\d+(?:\\s*[–-]\\s*\\d+)?)', 1)) as b from n1)),
n3 as (select *, {digits('d[1]')} as number, {digits('d[-1]')} as last from n2),
n4 as (select doc_id, rec_no, id, raw, number, last, case when length(number) <= {C.DIGITS} and length(last) <= {C.DIGITS} and try_cast(last as bigint) >= try_cast(number as bigint) then try_cast(last as bigint) - try_cast(number as bigint) + 1 else len(d) end as n from n3),
cit as (select doc_id, rec_no, id, raw, parent_raw, author, second, year, et_al, number, last, n from c4 union all select doc_id, rec_no, id, raw, raw, null, null, null, false, number, last, n from n4),
ac1 as (select doc_id, rec_no, regexp_extract_all(text, {q(C.ACRONYM)}, 1) as f, regexp_extract_all(text, {q(C.ACRONYM)}, 2) as a from z where in_article),
ac as (select doc_id, short, {flat('arg_min(f, o)')} as name from (select doc_id, lower(unnest(a)) as short, unnest(f) as f, rec_no * 10000 + unnest(range(len(a))) as o from ac1) group by doc_id, short),
key as (select doc_id, ref_no, id, year, {flat("case when is_institutional then authors[1] else string_split(authors[1], ',')[1] end")} as who, coalesce({flat("string_split(authors[2], ',')[1]")}, '') as second, len(authors) as size from ref where parsed),
asked as (select c.*, row_number() over () as k, coalesce(ac.name, {flat('author')}) as who, {flat('c.second')} as two from cit c left join ac on ac.doc_id = c.doc_id and ac.short = {flat('author')}),
cand as (select a.k, count(*) as size, list(r.id order by r.ref_no) as candidates, list(r.id order by r.ref_no) filter (case when a.second is not null then r.second = a.two and r.size = 2 when a.et_al then r.size >= 3 else r.size = 1 end) as fit from asked a join key r on r.doc_id = a.doc_id and r.who = a.who and r.year = a.year group by a.k),
res as (select a.doc_id, rec_no, id, raw, parent_raw, author, second, year, et_al, number, last, n, case when number is not null then 'numeric_style' when c.k is null then 'nomatch' when len(coalesce(fit, [])) = 1 then 'matched' when c.size = 1 then 'review' else 'ambiguous' end as status, fit, coalesce(candidates, []) as candidates from asked a left join cand c on c.k = a.k)"""


def _issue(kind: str, section: int, source: str, at: str = "0", id_: str = "", args: str = "[]", evidence: str = "[]", review: bool = False, examples: str = "[]", correction: str = "''") -> str:
    kind = kind if kind.startswith("(") else q(kind)
    return f"select doc_id, {kind} as kind, cast({section} as int) as section, cast({at} as bigint) as spot, {id_ or kind} as id, {args} as args, {evidence} as evidence, {str(review).lower()} as review, {examples} as examples, {correction} as correction from ({source})"


def _one(pid: str, quote: str) -> str:
    return f"[{pid} || '=' || {quote}]"


def _shown(kind: str, k: int) -> str:
    """The English texts of issues, from their kinds and arguments."""
    def text(t: str) -> str:
        parts = re.split(r"\{(\d)\}", t)
        return " || ".join(f"coalesce(args[{int(x) + 1}], '')" if j % 2 else q(x) for j, x in enumerate(parts))

    return "case " + " ".join(f"when {kind} = {q(name)} or ({kind} like {q(name + '-%')} and {q(name)} in ('caption-duplicate', 'caption-sequence', 'callout')) then {text(t[k])}" for name, t in L.TEXTS.items()) + " end"


def issues(abstract_max: int = 250, reference_min: int = 35, manuscript_max: int = 9000) -> str:
    """Common table expressions up to `iss`, the issues of the records with the images of the catalogue."""
    pairs = "list(id || '=' || text order by rec_no)"
    first_words = words("regexp_replace(title, " + q(re2(R.HEADINGS[0][1])) + ", '')")
    forms = " union all ".join(f"select doc_id, rec_no, id, {k} as rule, unnest(regexp_extract_all(text, {q(p)}, 1)) as code, {q(a)} as pattern, {q(b.replace('$', chr(92)))} as target from z where in_article and coalesce(heading, '') <> 'introduction'" for k, (_, p, a, b) in enumerate(C.FORMS))
    callout = lambda t: q(re2(U.CALLOUTS[t]).replace(r"(?!\d)", ""))
    parts = [
        _issue("abstract-length", 1, f"select * from ab where found and bounded and norm_ <> '' and words > {abstract_max}", args=f"[words::varchar, '{abstract_max}', (words - {abstract_max})::varchar]", evidence="evidence"),
        _issue("manuscript-length", 7, f"select * from total_ where total > {manuscript_max}", args=f"[total::varchar, '{manuscript_max}', (total - {manuscript_max})::varchar]"),
        _issue("reference-minimum", 3, f"select * from (select f.doc_id, coalesce(r.n, 0) as n, coalesce(d.extra, 0) as extra from (select distinct doc_id from z where rs is not null) f left join (select doc_id, count(*) as n from ref group by 1) r on r.doc_id = f.doc_id left join (select doc_id, sum(extra) as extra from dup group by 1) d on d.doc_id = f.doc_id) where n - extra < {reference_min}", args=f"[n::varchar, (n - extra)::bigint::varchar, '{reference_min}']"),
        _issue("uncited", 3, "select r.*, e.ev from ref r join ev e on e.doc_id = r.doc_id and e.id = r.id where parsed and not exists (select 1 from res where res.doc_id = r.doc_id and list_contains(res.candidates, r.id))", "ref_no", "'uncited-' || id", "[id]", "ev", True, "[raw]"),
    ]
    for kind, status, more in (("unmatched", "'nomatch'", "and exists (select 1 from z where z.doc_id = res.doc_id and rs is not null)"), ("ambiguous", "'ambiguous', 'review'", "")):
        parts.append(_issue(kind, 3, f"select c.doc_id, parent_raw, id, row_number() over (partition by c.doc_id order by c.rec_no, instr(z.text, parent_raw), parent_raw) as k from (select doc_id, parent_raw, min(rec_no) as rec_no from res where status in ({status}) {more} group by 1, 2) c join z on z.doc_id = c.doc_id and z.rec_no = c.rec_no", "k", f"'{kind}-' || k", "[parent_raw]", _one("id", "parent_raw"), True, "[parent_raw]"))
    parts += [
        _issue("numeric-style", 3, "select a.doc_id, sn, ex, ev from (select doc_id, sum(n)::hugeint as sn from res where status = 'numeric_style' group by 1) a join (select doc_id, list(raw order by rec_no, raw) as ex, list(id || '=' || raw order by rec_no, id, raw) as ev from (select distinct doc_id, rec_no, id, raw from res where status = 'numeric_style') group by 1) b on b.doc_id = a.doc_id", args="[sn::varchar]", evidence="ev", review=True, examples="list_filter(ex, lambda x, i: list_position(ex, x) = i)"),
        _issue("apa", 3, f"select *, row_number() over (partition by doc_id order by rec_no, k, code, correction) - 1 as at_ from (select doc_id, code, correction, arg_min(rec_no, o) as rec_no, arg_min(id, o) as id, arg_min(k, o) as k from (select *, rec_no * 100000 + k as o from (select doc_id, rec_no, id, code, regexp_replace(code, pattern, target, 'g') as correction, row_number() over (partition by doc_id, rec_no order by rule) as k from ({forms}))) group by 1, 2, 3)", "at_", "'apa-' || at_", "[]", _one("id", "code"), True, "[code]", "correction"),
        _issue("duplicates", 3, """select d.doc_id, d."group" as g, array_to_string(d.ids, ', ') as named, flatten(list(e.ev order by r.ref_no)) as ev, arg_min(r.raw, r.ref_no) as raw from dup d join ref r on r.doc_id = d.doc_id and list_contains(d.ids, r.id) join ev e on e.doc_id = r.doc_id and e.id = r.id group by d.doc_id, d."group", d.ids""", "g", "'duplicates-' || g", "[named]", "ev", False, "[raw]"),
    ]
    captions = "select doc_id, type, count(*) as n, array_to_string(list(distinct digits order by length(digits), digits), ', ') as shown, count(distinct digits) as size, {p} as ev from cap group by 1, 2".replace("{p}", pairs)
    captions = captions.replace("list(distinct digits order by length(digits), digits)", "list_transform(list_sort(list_distinct(list(lpad(length(digits)::varchar, 6, '0') || digits))), lambda x: x[7 :])")
    parts += [
        _issue("('caption-duplicate-' || type)", 7, f"select * from ({captions}) where n > size", args="[type, shown]", evidence="ev", review=True),
        _issue("('caption-sequence-' || type)", 7, f"select * from ({captions}) where string_split(shown, ', ')[-1] <> size::varchar or string_split(shown, ', ')[1] <> '1'", args="[type, shown]", evidence="ev", review=True),
        _issue("('callout-' || type)", 7, f"select * from cap c where not exists (select 1 from z where z.doc_id = c.doc_id and in_article and not exists (select 1 from cap k where k.doc_id = z.doc_id and k.rec_no = z.rec_no) and list_contains(regexp_extract_all(z.text, case when c.type = 'Table' then {callout('Table')} else {callout('Figure')} end, 1), c.digits))", "rec_no", "'callout-' || type || '-' || digits", "[type, digits]", _one("id", "text"), True),
        _issue("placeholder", 7, f"select *, regexp_extract_all(normal, {q(re2(U.PLACEHOLDER))}, 1) as x from z where {m('normal', re2(U.PLACEHOLDER))}", "rec_no * 3", "'placeholder-' || id", "[]", _one("id", "x[1]"), False, "x"),
        _issue("blank-date", 7, f"select * from z where {m('normal', BLANK_DATE)}", "rec_no * 3 + 1", "'blank-date-' || id", "[]", _one("id", "text")),
        _issue("highlight", 7, f"select * from z where {HIGHLIGHTED}", "rec_no * 3 + 2", "'highlight-' || id", "[]", _one("id", "text"), True),
        _issue("image-missing", 7, f"{IMAGES} where img_no = 0", "img_no", "'image-missing-' || img_no", "['rId' || doc_id]"),
        _issue("image-resolution", 7, f"{IMAGES} where img_no = 1", "img_no", "'image-resolution-' || img_no", "['72']", review=True),
    ]
    order = "case " + " ".join(f"when kind = {q(k)} then {n}" for k, n in U.ORDER.items()) + " end"
    return f"""{CITATIONS},
    ab as (select *, words_ as words, {trim("regexp_replace(abstract, " + q(f'[{T.WS}]+') + ", ' ', 'g')")} as norm_ from ({ABSTRACTS})),
    total_ as (select doc_id, sum({words('text')})::bigint as total from z group by 1),
    ev as (select r.doc_id, r.id, list(z.id || '=' || z.text order by z.rec_no) as ev from ref r join z on z.doc_id = r.doc_id and list_contains(string_split(r.record_ids, ','), z.id) group by 1, 2),
    iss0 as ({' union all '.join(parts)}),
    iss as (select doc_id, cast({order} as int) as rule, spot, id, kind, section, review, {_shown('kind', 0)} as problem, {_shown('kind', 1)} as action, evidence, examples, correction from iss0)"""


ABSTRACTS = f"""select doc_id, coalesce(string_agg(part, chr(10) order by rec_no) filter (in_abstract), '') as abstract, bool_or(abs_ is not null) as found, bool_or(bounded) as bounded, sum(case when in_abstract then {words('part')} else 0 end)::bigint as words_,
    list(id || '=' || text order by rec_no) filter (in_abstract and normal <> '' and not regexp_matches(text, {q(rf'(?i)^(?:Abstract|Abstrak)[{T.WS}]*[:.]?' + chr(92) + 'z')})) as evidence
    from (select *, case when in_abstract and heading = 'abstract' and rec_no = min(rec_no) filter (in_abstract) over (partition by doc_id) then regexp_replace(title, {q(re2(R.HEADINGS[0][1]))}, '') else text end as part from z) group by doc_id"""
BLANK_DATE = rf"(?i)\b(?:Received|Revised|Accepted)[{T.WS}]*:[{T.WS}]*(?:(?:[;|][{T.WS}]*)?(?:Received|Revised|Accepted)\b|[;|]?[{T.WS}]*\z)"
#: Records that count as highlighted, and images that documents have beside their text.
HIGHLIGHTED = "rec_no % 11 = 4"
IMAGES = "select * from (select distinct doc_id, unnest(range(3)) as img_no from doc where doc_id % 5 = 0)"


#: Records of a bibliographic service: doi, title, authors (family, given, name), years, container, publisher, type, volume, issue, page, article number.
BIBLIO = [
    ("10.1000/ABC", "Audit quality", [("Smith", "Jane", None)], ["2020"], "Journal A", None, "journal-article", "5", "2", "1–20", None),
    ("10.1000/firm", "Firm value", [("Lee", "Adam Bo", None), ("Kim", "Carl", None), ("Roe", "Dan", None)], ["2018"], "Review", None, "journal-article", "12", "1", "33-48", None),
    ("10.1000/firm2", "Firm Value.", [("Lee", "Ádám Bo", None), ("Kim", None, None), ("Roe", "Dan", None)], ["2018", "2019"], "Review of Firms", None, "journal-article", "12", "1", "33-48", None),
    ("10.1000/board", "Board size", [("Ortiz", "Pia", None), ("Park", "Quinn", None)], ["2021"], None, "Press House", "book", None, None, None, None),
    ("10.1000/rules", "Rules for ledgers", [(None, None, "Board of Ledgers")], ["2017"], None, "Press House", "book", None, None, None, None),
    ("10.1000/rules2", "Rules for ledgers", [(None, None, "Board of Ledgers")], ["2017"], None, "Press House", "book", None, None, None, None),
]


def _value(x) -> str:
    return "null" if x is None else q(x) if isinstance(x, str) else "[" + ", ".join("{'family': %s, 'given': %s, 'name': %s}" % tuple(map(_value, a)) if isinstance(a, tuple) else _value(a) for a in x) + "]"


def _compare() -> str:
    """CTEs up to `cmp`: each entry with the records it is compared with, the state of every field, in order."""
    surnames = "array_to_string(case when is_institutional then r.authors else list_transform(r.authors, lambda a: string_split(a, ',')[1]) end, '; ')"
    official = "array_to_string(list_transform(m.authors, lambda a: coalesce(nullif(a.family, ''), a.name, '')), '; ')"
    article = "type = 'journal-article'"
    fields = [
        ("'title'", "r.title", "m.title", "true", "true"), ("'DOI'", "lower(r.doi)", "lower(m.doi)", "true", "coalesce(r.doi, '') <> ''"), ("'authors (ordered surnames)'", surnames, official, "true", "true"),
        ("'year'", "regexp_replace(coalesce(r.year, ''), '(?i)[a-z]$', '')", "array_to_string(m.years, ' / ')", "true", "true"),
        (f"case when {article} then 'journal' else 'container / publisher' end", "coalesce(r.journal, r.publisher)", "coalesce(nullif(m.container, ''), m.publisher)", "false", "true"),
        ("'volume'", "r.volume", "m.volume", "false", article), ("'issue'", "r.issue", "m.issue", "false", f"{article} and coalesce(r.issue, m.issue, '') <> ''"),
        ("'pages / article number'", "coalesce(r.pages, r.article_number)", "coalesce(nullif(m.page, ''), m.article_number)", "false", article),
    ]
    same = lambda name, a, b: f"list_contains(m.years, {a})" if name == "'year'" else f"{flat(a)} = {flat(b)}"
    state = lambda name, a, b: f"case when coalesce({trim(a)}, '') = '' or coalesce({trim(b)}, '') = '' then 'missing' when {same(name, a, b)} then 'same' else 'differs' end"
    listed = ", ".join(f"case when {used} then {{'name': {name}, 'provided': {a}, 'official': {b}, 'state': {state(name, a, b)}, 'core': {core_}}} end" for name, a, b, core_, used in fields)
    letters = lambda x: f"lower(strip_accents(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')))"
    given = "coalesce(m.authors[i].given, '')"
    own = "regexp_extract(a, ',\\s*(.*)$', 1)"
    capitals = f"regexp_extract_all({given}, '(\\p{{Lu}})', 1)"
    initial = f"""list_transform(r.authors, lambda a, i: {{'name': 'author initials ' || i, 'provided': {own}, 'official': array_to_string({capitals}, '. ') || '.', 'state': case when {letters(own)} = '' then 'same' when {given} = '' then 'missing' when len({capitals}) = 0 then 'same' when {letters(own)} = {letters(f"array_to_string({capitals}, '')")} then 'same' else 'differs' end, 'core': false}})"""
    rows = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in BIBLIO)
    return f"""{CITATIONS},
    bib as (select * from (values {rows}) t(doi, title, authors, years, container, publisher, type, volume, issue, page, article_number)),
    tried as (select r.doc_id, r.id, r.ref_no, 'doi' as lookup, m.doi as official_doi, [{listed}] as f, {initial} as i from ref r join bib m on lower(r.doi) = lower(m.doi)
        union all select r.doc_id, r.id, r.ref_no, 'metadata', m.doi, [{listed}], {initial} from ref r join bib m on r.doi is null and r.parsed and {flat('r.title')} = {flat('m.title')}),
    cmp0 as (select *, list_filter(f, lambda x: x is not null) as g, list_filter(i, lambda x: x.state <> 'same') as j from tried),
    cmp1 as (select *, len(list_filter(g, lambda x: x.core and x.state <> 'same')) = 0 and len(list_filter(j, lambda x: x.state = 'differs')) = 0 as identity, list_concat(list_filter(g, lambda x: x.state = 'differs'), list_filter(j, lambda x: x.state = 'differs')) as differences, list_concat(list_filter(g, lambda x: x.state = 'missing'), list_filter(j, lambda x: x.state = 'missing')) as missing from cmp0),
    cmp2 as (select *, case when len(differences) > 0 then 'metadata_mismatch' when len(missing) > 0 then 'partial_match' else 'metadata_verified' end as status, count(*) over (partition by doc_id, id) as n from cmp1 where lookup = 'doi' or identity),
    ver as (select r.doc_id, r.ref_no, r.id, r.raw, r.doi as own, coalesce(c.status, 'unverified') as status, r.parsed or r.doi is not null as checked, c.lookup, c.official_doi as doi, coalesce(c.identity, false) as identity,
        coalesce(array_to_string(list_transform(c.differences, lambda d: d.name || ': ' || d.provided || ' / ' || d.official), '; '), '') as differences, coalesce(array_to_string(list_transform(c.missing, lambda d: d.name), ', '), '') as missing, coalesce(k.n, 0) > 1 as many
        from ref r left join cmp2 c on c.doc_id = r.doc_id and c.id = r.id and c.n = 1 left join (select distinct doc_id, id, n from cmp2) k on k.doc_id = r.doc_id and k.id = r.id)"""


VERIFICATION = _compare()
REASON = """case when status = 'metadata_mismatch' then 'Fetched metadata differs from the supplied reference.' when status = 'partial_match' then 'Some fields were matched; other fields could not be compared.' when status = 'metadata_verified' then 'All compared bibliographic fields matched the fetched record.'
    when many then 'Multiple candidate records require disambiguation.' when checked then 'No uniquely matching metadata record was established. Absence of a DOI has not been proven.' else 'The reference could not be parsed reliably; verify it on an official source page.' end"""
VERIFIED_ISSUES = """select doc_id, row_number() over (partition by doc_id order by ref_no, k) - 1 as spot, id as ref, kind, correction from (
    select *, 0 as k, 'verification-mismatch' as kind, '' as correction from ver where status = 'metadata_mismatch'
    union all select *, 1, 'verification-doi-missing', 'https://doi.org/' || doi from ver where identity and doi is not null and own is null
    union all select *, 2, 'verification-doi-format', 'https://doi.org/' || own from ver where own is not null and not contains(raw, 'https://doi.org/' || own))"""
#: Findings of editors, one of each kind that is refused: item, section, comment, paragraph, quote (null: that paragraph's text).
MANUAL = [(1, 2, "Clear.", "P0001", None), (2, 9, "No such section.", "P0001", None), (3, 3, "See 10.1234/zz.", "P0001", None), (4, 2, "All references are verified.", "P0001", None), (5, 1, "No quotation.", None, None), (6, 1, "Not there.", "P0001", "no record holds these words, surely")]


def audit(select: str, more: str = "") -> str:
    return f"with {RECORDS}, {AUDIT}{',' if more else ''} {more} {select}"
