"""What reports show of each document's findings, by one pass of its text.

`detectors.findings` deals out words, pairs of words and all places by document and joins them. A report
needs counts and the first places only, and a worker that has a document's text has all of that document:
here the tokens of the same scan go through the same rules where the text is, so nothing is shuffled,
persisted or joined. Rules and results are those of `detectors`; tests compare the two.
"""

from __future__ import annotations

import functools
import gc
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import detectors as D
from . import tokens as K

#: In the order of reports.
CATEGORIES = ("case", "hyphenation", "identifier", "spelling", "glossary", "acronym", "phrase", "reorder", "fuzzy")
CASE, HYPHENATION, IDENTIFIER, SPELLING, GLOSSARY, ACRONYM, PHRASE, REORDER, FUZZY = range(len(CATEGORIES))
SHOWN, SPAN = 3, 45
BLOCKS = "struct<words:int,blocks:array<struct<category:string,items:array<struct<key:string,summary:string,contexts:array<string>,shown:int,total:int>>>>>"
#: Words and pairs of words whose properties a worker remembers.
REMEMBERED = 50_000
#: A worker holds what it finds in a batch several times over.
BATCH_BYTES = 1 << 19
BLANK = re.compile(f"[{T.WS}]+")
MARKUP = str.maketrans("", "", "*_#>")


def python(pattern: str, to: str = "") -> tuple[re.Pattern, str]:
    """A pattern and replacement of Java's engine for Python's, which spells ends and groups otherwise."""
    return re.compile(pattern.replace(r"\z", r"\Z")), to.replace("$", "\\")


# of lines; Java's engine knows ASCII alone here, and its dot stops at every line terminator
HEADING, CAPTION, REFERENCES = (re.compile(p.replace(r"\z", r"\Z"), re.A) for p in (T.HEADING_LINE, T.CAPTION_LINE, T.REFERENCES_LINE))
BOLD = re.compile(rf"^[{T.WS}]*\*\*[^\n\r\x85\u2028\u2029]+\*\*[{T.WS}]*\Z")
CAPITALS, SMALL = re.compile("[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]"), re.compile("[a-z]")


def snippet(text: str, start: int, end: int, span: int = SPAN) -> str:
    """`T.snippet` of one place, cut out without a look at the rest."""
    a, b = max(start - span, 0), min(end + span, len(text))
    mid = text[a:b]
    if not mid.isprintable() or "  " in mid:  # the blank is the only white space that is printable
        mid = BLANK.sub(" ", mid)
    return ("…" if a > 0 else "") + mid.strip(" ") + ("…" if b < len(text) else "")


@functools.cache
def _lowers(spark: SparkSession) -> tuple[tuple[int, str], ...]:
    """Characters whose lower case is another in Spark than in Python (which may know another version of Unicode), with Spark's."""
    every = "\n".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))))
    low = spark.createDataFrame([(every,)], "c string").select(F.lower("c")).first()[0]
    return tuple((ord(c), x) for c, x in zip(every.split("\n"), low.split("\n"), strict=True) if x != c.lower())


def line_flags(lines: list[str]) -> list[int]:
    """`tokens.line_flags` of a text's lines."""
    out = []
    for line in lines:
        core = (line.translate(MARKUP) if "*" in line or "_" in line or "#" in line or ">" in line else line).strip(T.BLANKS)
        short = core and len(core) <= T.LONGEST_HEADING
        excluded = line.count("|") > 1 or short and (BOLD.search(line) or CAPITALS.search(core) and not SMALL.search(core) or HEADING.search(core) or CAPTION.search(core))
        out.append((1 if excluded else 0) + (2 if short and REFERENCES.search(core) else 0))
    return out


class Memory(dict):
    """Values by key, made when they are first asked for; emptied when there are many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Rules:
    """The detectors' rules for the tokens of one document."""

    SPELLING = [python(p, to) for p, to in T.SPELLING_RULES]
    SPELLED = python("|".join(p for p, _ in T.SPELLING_RULES))[0]  # no rule changes any other word
    SUFFIX = python(rf"^(.{{3,}}?)(?:{'|'.join(T.SUFFIXES)})\z", "$1")
    PREFIX = python(rf"^(?:{'|'.join(T.PREFIXES)})(.{{3,}})\z", "$1")
    DEFINITION, DEFINED = re.compile(T.ACRONYM_DEFINITION), re.compile(r"\([A-Z]{2,8}\)")
    CAPITALS, CONTENT, LETTERS = re.compile(r"[A-Z]{2,8}"), re.compile("[a-zA-Z]{3,}"), re.compile("[a-z]{4,}")
    LETTER, CAPITAL, SMALL = re.compile("[a-zA-Z]"), re.compile("[A-Z]"), re.compile("[a-z]")
    CAMEL, OTHER, BARS = re.compile("[a-z][a-zA-Z0-9]*"), re.compile("[0-9_-]"), re.compile("[_-]+")
    EDGES = re.compile(rf"^[{T.WS}]+|[{T.WS}]+\Z")

    def __init__(self, lowers: tuple, glossary: tuple, undefined: bool, sensitivity: int):
        self.lowers, self.undefined = dict(lowers), undefined
        self.glossary = [(k, p, a, self.lower(a), re.compile(T.term_pattern(a))) for k, p, a in glossary]
        self.edits, self.rare = D.SENSITIVITY.get(sensitivity, D.SENSITIVITY[2])
        self.words, self.lows, self.stems, self.apart = (Memory(f) for f in (self.word, self.low, self.stem, self.distance))
        self.stop, self.known, self.common = set(T.PHRASE_STOPWORDS), set(T.KNOWN_ACRONYMS), set(T.FUZZY_STOPWORDS)

    def lower(self, text: str) -> str:
        if self.lowers and not text.isascii() and not self.lowers.keys().isdisjoint(map(ord, text)):
            text = text.translate(self.lowers)
        return text.lower()

    # properties of words

    def word(self, text: str) -> tuple:
        """Lower case, lower case if it is a content word, style and root of an identifier, whether it is an unknown acronym."""
        low, ascii_ = self.lower(text), text.isascii()
        content = low if ascii_ and self.CONTENT.fullmatch(text) and low not in self.stop else None
        style = None
        if "_" in text:
            style = "snake_case"
        elif "-" in text and self.LETTER.search(text):
            style = "kebab-case"
        elif self.CAPITAL.match(text):
            style = "PascalCase" if self.SMALL.search(text) and self.CAPITAL.search(text, 1) else None
        elif self.CAMEL.fullmatch(text) and self.CAPITAL.search(text):
            style = "camelCase"
        root = style and self.lower(self.BARS.sub(" ", text)).replace(" ", "")
        name = (style, root) if style and len(root) >= 4 else None
        return low, content, name, bool(self.CAPITALS.fullmatch(text)) and text not in self.known

    def low(self, low: str) -> tuple:
        """The key without hyphens (of words with one), the spelling key, and for near spellings the block and counts of letters of a word."""
        if not self.LETTERS.fullmatch(low):
            joined = low.replace("-", "").replace("_", "") if "-" in low or "_" in low else ""
            return joined if len(joined) >= 4 else None, None, None
        key, near = low, None
        if self.SPELLED.search(low):
            for pattern, to in self.SPELLING:
                key = pattern.sub(to, key)
        if len(low) >= 6 and low not in self.common:
            letters = 0
            for c in low[2:-1]:  # a bit for a letter's first time, one for more
                k = 2 * (ord(c) - 97)
                letters |= 1 << k + (letters >> k & 1)
            near = low[:2] + low[-1], letters, len(low), low
        return None, key, near

    def stem(self, low: str) -> str:
        (suffix, one), (prefix, two) = self.SUFFIX, self.PREFIX
        return prefix.sub(two, suffix.sub(one, low))

    @staticmethod
    def distance(pair: tuple[str, str]) -> int:
        """Edits between two words, by columns of bits."""
        a, b = pair
        places: dict[str, int] = {}
        for k, c in enumerate(a):
            places[c] = places.get(c, 0) | 1 << k
        every, last = (1 << len(a)) - 1, 1 << len(a) - 1
        up, down, out = every, 0, len(a)
        for c in b:
            same = places.get(c, 0)
            x = same | down
            zero = (((same & up) + up) ^ up) | same
            more, less = (down | ~(zero | up)) & every, up & zero
            out += (more & last > 0) - (less & last > 0)
            more, less = more << 1 | 1, less << 1
            up, down = (less | ~(x | more)) & every, more & x & every
        return out

    def near(self, block: np.ndarray, letters: np.ndarray, size: np.ndarray, uses: np.ndarray):
        """Places (a, b) of words that may be near, of words sorted by block and first place."""
        most = np.where(size > 8, self.edits + 1, self.edits)
        a, apart = np.arange(len(block)), 1
        while len(a):
            a = a[a + apart < len(block)]
            a = a[block[a] == block[a + apart]]
            b = a + apart
            # an edit takes one letter away at most, and adds one
            fits = (np.abs(size[a] - size[b]) <= self.edits) & (np.minimum(uses[a], uses[b]) <= self.rare)
            fits &= (np.bitwise_count(letters[a] & ~letters[b]) <= most[a]) & (np.bitwise_count(letters[b] & ~letters[a]) <= most[a])
            yield from zip(a[fits].tolist(), b[fits].tolist(), most[a[fits]].tolist())
            apart += 1

    def findings(self, texts: list[str], toks: pa.StructArray) -> list[list[list]]:
        """For each text and category: key, (place, form, n) of each variant, the first SHOWN spans, and how many there are."""
        out = [[[] for _ in CATEGORIES] for _ in texts]
        definitions = self.of_texts(texts, out)
        if len(toks.field("text").values):
            self.of_words(toks, out, definitions)
        return out

    def of_words(self, toks: pa.StructArray, out: list, definitions: list[dict]) -> None:
        cuts = toks.field("text").offsets.to_numpy()
        doc = np.repeat(np.arange(len(out)), np.diff(cuts))
        start, flags = (toks.field(c).values.to_numpy() for c in ("start", "flags"))
        coded = toks.field("text").values.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        every = [self.words[w] for w in words]
        ids: dict[str, int] = {}
        low_of = np.array([ids.setdefault(x[0], len(ids)) for x in every])
        lows, infos = list(ids), [self.lows[x] for x in ids]
        places, begin = code.tolist(), start.tolist()
        word = lambda i: words[places[i]]
        span = lambda i: (begin[i], begin[i] + len(words[places[i]]))
        first = lambda *many: [span(i) for i in sorted(chain.from_iterable([m[:SHOWN] for m in many]))[:SHOWN]]
        usable = flags & K.IS_USABLE > 0
        fit = usable.tolist()

        def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Rows in order of a key, where each key's begin, and where the last ends."""
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            return order, new, np.append(new, len(key))

        def by_form(at: list[int]) -> dict[str, list[int]]:
            forms: dict[str, list[int]] = {}
            for i in at:
                forms.setdefault(words[places[i]], []).append(i)
            return forms

        # words of a document by their lower case
        order, new, stops = grouped(doc * len(ids) + low_of[code])
        own_doc, own_low, own_first = doc[order[new]], low_of[code[order[new]]], order[new]
        own_key = own_doc * len(ids) + own_low
        uses = np.add.reduceat(usable[order].astype(np.int64), new)
        rows, ends, docs, spelt = order.tolist(), stops.tolist(), own_doc.tolist(), own_low.tolist()
        of = lambda g: rows[ends[g] : ends[g + 1]]
        of_usable = lambda g: [i for i in of(g) if fit[i]]
        for g in np.flatnonzero(np.minimum.reduceat(code[order], new) != np.maximum.reduceat(code[order], new)).tolist():
            low = lows[spelt[g]]
            if uses[g] > 1 and len(low) >= 3 and self.LETTER.search(low) and not self.OTHER.search(low):
                own = of_usable(g)
                forms = by_form(own)
                if sum(any(not flags[i] & K.AT_BOUNDARY for i in x) for x in forms.values()) > 1:
                    out[docs[g]][CASE].append((low, [(x[0], w, len(x)) for w, x in forms.items()], first(own), len(own)))
        for k, into in ((0, HYPHENATION), (1, SPELLING)):
            changed = np.array([x[k] is not None and x[k] != low for x, low in zip(infos, lows)])
            groups: dict[tuple[int, str], list[int]] = {}
            for g in np.flatnonzero(changed[own_low]).tolist():
                groups.setdefault((docs[g], infos[spelt[g]][k]), []).append(g)
            for (d, key), many in groups.items():
                if key in ids and (into == HYPHENATION or infos[ids[key]][1] == key):  # the word that is written like the key
                    g = int(np.searchsorted(own_key, d * len(ids) + ids[key]))
                    many += [g] if g < len(own_key) and own_key[g] == d * len(ids) + ids[key] else []
                forms = [lows[spelt[g]] for g in many]
                if len(forms if into == SPELLING else {4 if "_" in x else 2 if "-" in x else 1 for x in forms}) > 1:
                    at = [of(g) for g in many]
                    out[d][into].append((key, [(x[0], low, len(x)) for low, x in zip(forms, at)], first(*at), sum(map(len, at))))

        # near spellings
        likely = np.flatnonzero(np.array([x[2] is not None for x in infos])[own_low] & (uses > 0))
        if len(likely):
            near, blocks = [infos[spelt[g]][2] for g in likely.tolist()], {}
            block = own_doc[likely] * len(likely) + np.array([blocks.setdefault(x[0], len(blocks)) for x in near])
            by = np.lexsort((own_first[likely], block))
            letters, size = (np.array([x[k] for x in near], t)[by] for k, t in ((1, np.uint64), (2, np.int64)))
            sorted_, own = likely[by].tolist(), Memory(of_usable)
            for k, m, most in self.near(block[by], letters, size, uses[likely][by]):
                g, h = sorted_[k], sorted_[m]
                a, b = lows[spelt[g]], lows[spelt[h]]
                if self.apart[a[2:-1], b[2:-1]] <= most and self.stems[a] != self.stems[b] and infos[spelt[g]][1] != infos[spelt[h]][1]:
                    x, y = own[g], own[h]
                    shown = first(x, y) if len(x) + len(y) > 2 else [span(x[0]), span(y[0])] if x < y else [span(y[0]), span(x[0])]
                    out[docs[g]][FUZZY].append((f"{a}~{b}" if a < b else f"{b}~{a}", [(0, a, len(x)), (1, b, len(y))], shown, len(x) + len(y)))

        # identifiers and acronyms
        roots: dict[tuple[int, str], list[int]] = {}
        for i in np.flatnonzero(np.array([x[2] is not None for x in every])[code]).tolist():
            roots.setdefault((int(doc[i]), every[places[i]][2][1]), []).append(i)
        for (d, root), at in roots.items():
            forms = by_form(at)
            if len({self.words[w][2][0] for w in forms}) > 1:
                out[d][IDENTIFIER].append((root, [(x[0], f"{w}  ({self.words[w][2][0]})", len(x)) for w, x in forms.items()], first(at), len(at)))
        if self.undefined:
            names: dict[tuple[int, str], list[int]] = {}
            for i in np.flatnonzero(np.array([x[3] for x in every])[code]).tolist():
                names.setdefault((int(doc[i]), word(i)), []).append(i)
            for (d, name), at in names.items():
                if len(at) >= 3 and name not in definitions[d]:
                    out[d][ACRONYM].append((f"{name}-undefined", [(at[0], f'{name}  (used {len(at)}×, no "(...)" definition found)', 0)], first(at), len(at)))

        # two content words, one character apart
        content = np.array([x[1] is not None for x in every])[code]
        two = np.flatnonzero((flags[:-1] & K.BESIDE > 0) & content[:-1] & content[1:])
        if not len(two):
            return
        a, b = low_of[code[two]], low_of[code[two + 1]]
        order, new, stops = grouped((doc[two] * len(ids) + np.minimum(a, b)) * len(ids) + np.maximum(a, b))
        of_two = lambda many: [(begin[i], begin[i + 1] + len(word(i + 1))) for i in many[:SHOWN]]
        for g in np.flatnonzero(np.diff(stops) > 1).tolist():
            at, d, orders = two[order[stops[g] : stops[g + 1]]].tolist(), int(doc[two[order[stops[g]]]]), {}
            for i in at:
                orders.setdefault((lows[low_of[code[i]]], lows[low_of[code[i + 1]]]), []).append(i)
            for (x, y), own in orders.items():
                forms = {}
                for i in own:
                    forms.setdefault(f"{word(i)} {word(i + 1)}", []).append(i)
                if len(forms) > 1 and len(own) > 2:
                    out[d][PHRASE].append((f"{x} {y}", [(z[0], w, len(z)) for w, z in forms.items()], of_two(own), len(own)))
            if len(orders) > 1:
                out[d][REORDER].append((" ".join(min(orders)), [(z[0], f"{word(z[0])} {word(z[0] + 1)}", len(z)) for z in orders.values()], of_two(at), len(at)))

    def of_texts(self, texts: list[str], out: list) -> list[dict]:
        """Findings of patterns of the texts; the acronyms that each defines."""
        defined = []
        for text, found in zip(texts, out):
            definitions: dict[str, list[tuple]] = {}
            if self.DEFINED.search(text):
                for m in self.DEFINITION.finditer(text):
                    definitions.setdefault(m[2], []).append((m.start(), m.end(), self.EDGES.sub("", m[1])))
            for name, many in definitions.items():
                fulls: dict[str, tuple] = {}
                for x in many:
                    fulls.setdefault(self.lower(x[2]), x)
                if len(fulls) > 1:
                    found[ACRONYM].append((name, [(x[0], f"{x[2]}{D.ARROW}{name}", 0) for x in fulls.values()], [x[:2] for x in many[:SHOWN]], len(many)))
            defined.append(definitions)
            low = self.lower(text)
            uses: dict[tuple, list] = {}
            for k, preferred, alt, key, pattern in self.glossary:
                if key in low and (hits := [m.span() for m in pattern.finditer(text)]):
                    uses.setdefault((k, preferred, alt, key), []).extend(hits)
            terms: dict[str, tuple[list, set]] = {}
            for (_, preferred, alt, key), hits in uses.items():
                forms, places = terms.setdefault(key, ([], set()))
                forms += [(0, f"{preferred}  (preferred)", 0), (1, alt, len(hits))]
                places.update(hits)
            found[GLOSSARY] += [(key, forms, sorted(places)[:SHOWN], len(places)) for key, (forms, places) in terms.items()]
        return defined


@functools.cache
def _rules(*options) -> Rules:
    return Rules(*options)


def without_collection(run):
    """Nothing here refers to itself, and looking for what does takes longer than the work, with so much remembered."""

    @functools.wraps(run)
    def out(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return run(*args)
        finally:
            if on:
                gc.enable()

    return out


def _pass(packed: bytes, options: tuple):
    def run(text: pa.Array) -> pa.Array:
        rules, table = _rules(*options), np.frombuffer(zlib.decompress(packed), np.uint8)
        n_words, blocks, category, items, key, summary, cuts, contexts, shown, totals = [], [0], [], [0], [], [], [0], [], [], []
        every_text = K.decoded(text)
        marks = [line_flags(t.split("\n")) for t in every_text]
        for texts, toks in K.runs(every_text, np.array([len(x) for x in marks], np.int64), np.fromiter(chain.from_iterable(marks), np.int64), table):
            n_words += np.diff(toks.field("text").offsets.to_numpy()).tolist()
            for t, own in zip(texts, rules.findings(texts, toks)):
                places: dict[tuple, str] = {}
                for name, found in zip(CATEGORIES, own):
                    if not found:
                        continue
                    found.sort(key=lambda x: x[0])
                    for k, forms, first, total in found:
                        forms.sort()
                        key.append(k)
                        summary.append(" ⇄ ".join([f"{form} ×{n}" if n > 0 else form for _, form, n in forms]))
                        for x in first:
                            if x not in places:
                                places[x] = snippet(t, *x)
                            contexts.append(places[x])
                        cuts.append(len(contexts))
                        shown.append(max(len(first), 1))
                        totals.append(total)
                    category.append(name)
                    items.append(len(key))
                blocks.append(len(category))
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        strings, ints = (lambda x: pa.array(x, pa.string())), (lambda x: pa.array(x, pa.int32()))
        item = pa.StructArray.from_arrays([strings(key), strings(summary), lists(cuts, strings(contexts)), ints(shown), ints(totals)], ["key", "summary", "contexts", "shown", "total"])
        block = pa.StructArray.from_arrays([strings(category), lists(items, item)], ["category", "items"])
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([ints(n_words), lists(blocks, block)], ["words", "blocks"])

    # annotations are strings in this module
    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(without_collection(run), BLOCKS)


def blocks(docs: DataFrame, glossary_pairs: list | None = None, check_undefined: bool = False, sensitivity: int = 1) -> DataFrame:
    """doc_id, words (the number of tokens) and blocks of each document (doc_id, text; distinct ids).

    A block is a category with its findings by key: summary, contexts (the first SHOWN snippets), shown
    and total as in `report.with_contexts`. Rows without an id have no findings.
    """
    spark = docs.sparkSession
    K.batches(spark, BATCH_BYTES)
    pairs = T.glossary_pairs() if glossary_pairs is None else glossary_pairs
    options = (_lowers(spark), tuple(map(tuple, pairs)), check_undefined, sensitivity)
    found = K.plain(docs).select("doc_id", _pass(K._classes(spark), options)("text").alias("x"))
    none = F.array().cast(BLOCKS.split("blocks:")[1][:-1])
    return found.select("doc_id", "x.words", F.when(F.col("doc_id").isNotNull(), F.col("x.blocks")).otherwise(none).alias("blocks"))
