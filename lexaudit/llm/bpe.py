"""Byte-level BPE encoding with the tokenizers library, each distinct chunk of text encoded once.

A text is cut before those spaces where the tokenizer's own splitting always cuts: a space next to
a non-space on either side. The ids of a text are then the concatenation of its chunks' ids, so a
worker calls the tokenizer for chunks it has not met and gathers the rest from memory. A newline
between non-spaces is a token of its own and cuts as well, and so does an added token (such as
<|endoftext|>), which the library finds in texts before anything else.

Arrow splits a batch's texts and finds their distinct chunks, so only those are looked up. ASCII
punctuation after letters is a token run of its own, so a word is encoded once whatever follows it.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, release

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT_FILE = "byte_bpe_50k.json"
END_ID = 2
#: A space between two whites, or between a white and the end: no cut there.
_UNSAFE = re.compile(r" (?<=\s )(?:\s|\Z)")
#: A newline beside other white space, or at the end: no cut before it.
_NEWLINE = re.compile(r"\n(?:(?<=\s\n)|(?=\s|\Z))")
#: Stands for a blank that is a newline, in texts that don't hold it.
_MARK = "\x00"
_SAFE = re.compile(r" (?=\S)|(?<=\S) ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class _Index(dict):
    """Numbers chunks as they come; owner notes the new ones."""

    def __init__(self, owner, spaced):
        super().__init__()
        self.owner, self.spaced = owner, spaced

    def __missing__(self, chunk):
        n = self.owner.size
        self.owner.size = n + 1
        self.owner.held += len(chunk)
        self[chunk] = n
        self.owner.new.append((self.spaced, chunk))
        return n

    def numbers(self, chunks: np.ndarray) -> np.ndarray:
        """Of distinct chunks."""
        found = list(map(self.get, chunks))
        new = [c for c, n in zip(chunks, found) if n is None]
        if new:
            n = self.owner.size
            self.owner.size = n + len(new)
            self.owner.held += sum(map(len, new))
            self.update(zip(new, range(n, n + len(new))))
            self.owner.new += [(self.spaced, c) for c in new]
            more = iter(range(n, n + len(new)))
            found = [next(more) if n is None else n for n in found]
        return np.asarray(found, np.int64)


class ChunkEncoder:
    """Encodes batches of texts. limit, most: chunks and their characters in memory before most are forgotten; kept: those that stay."""

    def __init__(self, path: str, limit: int = 600_000, kept: int = 100_000, most: int = 8 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # every chunk comes once
        self.vocabulary = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids
        # how byte-level models write bytes: printable ones as themselves, the others from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        self.table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        state = json.loads(self.tok.to_str())
        pre = state.get("pre_tokenizer") or {}
        #: Chunks are exact for this kind of splitting only; others are encoded text by text.
        self.chunked = state.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = state.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        self.chunked = self.chunked and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.limit, self.kept, self.most = limit, kept, most
        self.clear()

    def clear(self) -> None:
        self.size, self.held, self.new = 0, 0, []
        self.rest, self.first = _Index(self, True), _Index(self, False)
        self.tails = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.len, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def shrink(self) -> None:
        """Keep the most frequent of the chunks that came more than once, long ones apart."""
        at = np.flatnonzero((self.met[: self.size] > 1) & (self.len[: self.size] <= 64))
        if len(at) > self.kept:
            at = at[np.argsort(-self.met[at], kind="stable")[: self.kept]]
        number = np.full(self.size, -1)
        number[at] = np.arange(len(at))
        flat, lens, met = self.ids(at), self.len[at], self.met[at] // 2
        number = number.tolist()
        old = [(index, [(c, number[i]) for c, i in index.items() if number[i] >= 0]) for index in (self.rest, self.first)]
        self.size, self.new = len(at), []
        self.rest, self.first = _Index(self, True), _Index(self, False)
        for index, (_, items) in zip((self.rest, self.first), old):
            index.update(items)
        self.held = sum(len(c) for _, items in old for c, _ in items)
        self.flat, self.used = flat, len(flat)
        self.start, self.len, self.met = np.cumsum(lens) - lens, lens, met

    def rest_now(self) -> None:
        """The end of a task: the worker may wait or do other work next."""
        self.shrink()
        release()

    def _put(self, at: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + 1024, np.uint32)])
        while self.size > len(self.start):
            self.start, self.len, self.met = (np.concatenate([x, np.zeros(len(x) + 1024, np.int64)]) for x in (self.start, self.len, self.met))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at], self.len[at] = self.used + np.cumsum(lens) - lens, lens
        self.used += len(ids)

    def _learn(self) -> None:
        base, new, self.new = self.size - len(self.new), self.new, []
        if len(self.tails) > 10_000:
            self.tails = {}
        # letters alone, or letters and punctuation, split in one way: the model gets the letters
        # directly, and a word that is known before other punctuation isn't encoded again
        words, at, odd, rare, same, source, ends = [], [], [], [], [], [], []
        tails, table, newline, known, marks = self.tails, self.table, self.newline, self.rest.get, string.punctuation
        spelled = lambda w: w if w.isascii() else w.encode().decode("latin-1").translate(table)
        for i, (spaced, chunk) in enumerate(new):
            if not spaced:
                odd.append(i)
                continue
            if chunk.isalpha():
                at.append(i)
                words.append("Ġ" + spelled(chunk))
                continue
            word = chunk.rstrip(marks)
            tail = chunk[len(word) :]
            letters = word[1:] if word[:1] == _MARK else word
            if not letters.isalpha() or len(tail) > 8:
                odd.append(i)
            elif (n := known(word, base)) < base:
                same.append(i)
                source.append(n)
                ends.append(tail)
            else:
                at.append(i)
                words.append(("Ġ" if letters is word else "") + spelled(letters))
                rare.append((len(words) - 1, letters is not word, tail))
        rare.reverse()
        for k in range(0, len(words), 4096):
            got = [[t.id for t in x] for x in map(self.tok.model.tokenize, words[k : k + 4096])]
            while rare and rare[-1][0] < k + 4096:
                j, broken, tail = rare.pop()
                got[j - k] = (newline if broken else []) + got[j - k] + (tails.get(tail) or self._tail(tail) if tail else [])
            self._put(base + np.asarray(at[k : k + 4096]), np.asarray([y for x in got for y in x], np.uint32), np.asarray([len(x) for x in got], np.int64))
        if same:
            source, more = np.asarray(source), [tails.get(t) or self._tail(t) for t in ends]
            n = np.stack([self.len[source], [len(x) for x in more]], axis=1)
            pool = np.concatenate([self.ids(source), np.asarray([y for x in more for y in x], np.uint32)])
            starts = np.cumsum(n, axis=0) - n
            starts[:, 1] += n[:, 0].sum()
            self._put(base + np.asarray(same), pool[ragged(starts.ravel(), n.ravel())], n.sum(axis=1))
        for k in range(0, len(odd), 1024):
            some = odd[k : k + 1024]
            got = [e.ids for e in self.tok.encode_batch_fast([self._shown(*new[i]) for i in some], add_special_tokens=False)]
            lens = np.asarray([len(x) for x in got], np.int64)
            self._put(base + np.asarray(some), np.asarray([y for x in got for y in x], np.uint32), lens)

    def _tail(self, tail: str) -> list[int]:
        self.tails[tail] = self.tok.encode(tail, add_special_tokens=False).ids
        return self.tails[tail]

    @staticmethod
    def _shown(spaced: bool, chunk: str) -> str:
        return chunk if not spaced else "\n" + chunk[1:] if chunk[:1] == _MARK else " " + chunk

    def chunks(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts one after the other, and how many each text has. Null is empty.

        The numbers hold until the next call."""
        if self.size > self.limit or self.held > self.most:
            self.shrink()
        collects = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            return self._chunks(texts)
        finally:
            if collects:
                gc.enable()

    def _numbered(self, tails: list) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of texts cut at each space, and where those of each begin and the last end."""
        parts = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        return self.rest.numbers(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()], parts.offsets.to_numpy().copy()

    def _chunks(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        # numbers by piece of text, None where those of the next of `tails` come
        index, counts, tails, owners = [], np.zeros(len(texts), np.int64), [], []
        rest, first = self.rest.__getitem__, self.first.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            for piece in self.cut.split(text) if self.chunked and any(a in text for a in self.added) else (text,):
                if not piece:
                    continue
                head, blank, tail = piece, "", ""
                if self.chunked and _MARK not in piece:
                    if "\n" in piece and not _NEWLINE.search(piece):
                        piece = piece.replace("\n", " " + _MARK)
                    if _UNSAFE.search(piece):
                        parts = _SAFE.split(piece)
                        head, got = parts[0], np.fromiter(map(rest, parts[1:]), np.int64, len(parts) - 1)
                    else:
                        head, blank, tail = piece.partition(" ")
                        got = None
                else:
                    got = np.zeros(0, np.int64)
                if head:
                    index.append(np.asarray([first(head)]))
                    counts[i] += 1
                if got is not None:
                    index.append(got)
                    counts[i] += len(got)
                elif blank:
                    index.append(None)
                    tails.append(tail)
                    owners.append(i)
        if tails:
            numbers, at = self._numbered(tails)
            np.add.at(counts, owners, np.diff(at))
            each = iter(np.split(numbers, at[1:-1]))
            index = [next(each) if x is None else x for x in index]
        if self.new:
            self._learn()
        all_ = np.concatenate(index) if index else np.zeros(0, np.int64)
        self.met[: self.size] += np.bincount(all_, minlength=self.size)
        return all_, counts

    def ids(self, index: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[index], self.len[index])]

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        index, counts = self.chunks(texts)
        ends = np.concatenate([[0], np.cumsum(self.len[index])])
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.ids(index), np.diff(ends[at])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def by_bytes(texts: list, most: int = 4 << 20):
    """Slices of a batch of texts of about so many characters, at least one text each."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at = i
            size = 0
        size += n
    if at < len(texts):
        yield at, len(texts)
