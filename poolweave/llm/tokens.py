"""Token ids of whole texts with the tokenizers library, reusing the ids of words seen before."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

#: So many words are remembered in a Python worker, some 40 MB; beyond that those that came up
#: twice, the most frequent first, and half as many. Words longer than LONGEST bytes are never kept.
#: AT_ONCE new words make up one text for the library.
REMEMBERED, LONGEST, AT_ONCE = 200_000, 64, 32
#: Words of Latin letters, in UTF-8: the pre-tokenizer leaves them whole.
LETTERS = re.compile(rb"\n?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: White space besides the space and the line break, and runs of those two: such texts are encoded
#: as a whole.
OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
RUNS = ("  ", " \n", "\n ", "\n\n")
#: Marks that are a token of their own behind a letter or digit and before white space.
MARKS = b",.;:!?"
_MARK = np.isin(np.arange(256), list(MARKS))
_BEFORE_MARK = np.array([bytes([b]).isalnum() for b in range(256)])
_NUMBER = np.zeros(256, np.int64)
_NUMBER[list(MARKS)] = np.arange(len(MARKS))


def _ranges(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first to first + size of all ranges, one after the other."""
    return np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokenizer:
    """A byte-level BPE tokenizer that reuses the ids of words.

    Its pre-tokenizer breaks before every single space, around every single line break and between
    a letter or digit and a punctuation mark. So the ids of a text are those of its words one after
    the other, and each new word goes through the tokenizers library once, many of them as one text
    with line breaks between. Texts with other white space, or two of these in a row, or with an
    added token of the tokenizer, where that rule does not hold, go through the library whole.

    The words of many texts are cut out and numbered together, without a step for each of them in
    Python; only different ones are looked up.
    """

    def __init__(self, path: str) -> None:
        self.inner = Tokenizer.from_file(path)
        # Marks like <|endoftext|> that are a token wherever they stand: no words.
        self.added = [str(t) for t in self.inner.get_added_tokens_decoder().values()]
        self.line_break = self._ids("\n")
        # A byte-level model sees a sign for each byte. Words of letters need no more cutting than
        # at line breaks, which is much quicker; where that gives other ids it is left.
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.signs = {b: signs(chr(b))[0][0][-1] for b in (*range(128), *range(128, 192))} | {0xC3: signs("é")[0][0][0]}
        self.letters: Tokenizer | None = Tokenizer(self.inner.model)
        self.letters.pre_tokenizer = pre_tokenizers.Split(self.signs[10], "isolated")
        for text in (" word\n Größe\n été\n " + "x" * 40, "\nword\nGröße\nñ\na\nABC"):
            signed = text.encode().decode("latin1").translate(self.signs)
            if self.letters and self.letters.encode(signed, add_special_tokens=False).ids != self._ids(text).tolist():
                self.letters = None
        none = np.empty(0, np.int64)
        self._forget([], none, none.astype("<u4"), none)
        self.long = False

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4")

    def _forget(self, words: list[bytes], sizes: np.ndarray, ids: np.ndarray, uses: np.ndarray) -> None:
        """Remember these words only. The first numbers are the marks; then come the words: behind a
        space without it, and behind a line break with it."""
        fixed = [self._ids(chr(b)) for b in MARKS]
        self.known: dict[bytes, int] = {}
        self.sizes, self.ids, self.uses = np.array([len(x) for x in fixed], np.int64), np.concatenate(fixed), np.zeros(len(fixed), np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self._add(words, sizes, ids, uses)

    def _add(self, words: list[bytes], sizes: np.ndarray, ids: np.ndarray, uses: np.ndarray) -> None:
        first = len(self.sizes)
        self.known.update(zip(words, range(first, first + len(words))))
        self.firsts = np.concatenate([self.firsts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.uses = np.concatenate([self.sizes, sizes]), np.concatenate([self.uses, uses])
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self, words: list[bytes]) -> None:
        """New words, some of them as one text with line breaks between; those of letters only
        without the pre-tokenizer."""
        plain = [w for w in words if w.isalpha() or LETTERS.fullmatch(w)] if self.letters else []
        if plain:
            self._learn_by(self.letters, plain)
            known = set(plain)
            words = [w for w in words if w not in known]
        self._learn_by(self.inner, words)

    def _learn_by(self, library: Tokenizer, words: list[bytes]) -> None:
        for behind_break in (False, True):
            own = [w for w in words if (w[:1] == b"\n") == behind_break]
            groups = [own[i : i + AT_ONCE] for i in range(0, len(own), AT_ONCE)]
            texts = [b"".join(g) if behind_break else b" " + b"\n ".join(g) for g in groups]
            whole = [t.decode() if library is self.inner else t.decode("latin1").translate(self.signs) for t in texts]
            sizes, ids = [], []
            for group, found in zip(groups, library.encode_batch_fast(whole, add_special_tokens=False)):
                x = np.array(found.ids, "<u4")
                breaks = np.flatnonzero(x == self.line_break[0])
                if len(self.line_break) != 1 or len(breaks) != len(group) - (not behind_break):
                    each = [self._ids((w if behind_break else b" " + w).decode()) for w in group]
                    sizes, ids = [*sizes, [len(e) for e in each]], [*ids, *each]
                elif behind_break:
                    sizes, ids = [*sizes, np.diff(np.append(breaks, len(x)))], [*ids, x]
                else:
                    sizes, ids = [*sizes, np.diff(np.concatenate([[-1], breaks, [len(x)]])) - 1], [*ids, x[x != self.line_break[0]]]
            if own:
                self._add(own, np.concatenate(sizes), np.concatenate(ids), np.zeros(len(own), np.int64))

    def _prune(self) -> None:
        """Where too many words are known, keep the half that came up most, of those up to LONGEST
        bytes; longer ones are not kept at all."""
        if len(self.known) <= REMEMBERED and not self.long:
            return
        words = [w for w in self.known if len(w) <= LONGEST]
        at = np.array([self.known[w] for w in words], np.int64)
        if len(words) > REMEMBERED:
            order = np.argsort(-self.uses[at], kind="stable")[: REMEMBERED // 2]
            order = order[self.uses[at[order]] > 1]
            words, at, self.uses = [words[i] for i in order.tolist()], at[order], self.uses // 2
        sizes = self.sizes[at]
        self.long = False
        self._forget(words, sizes, self.ids[_ranges(self.firsts[at], sizes)], self.uses[at])

    def _numbers(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``data`` is texts with a line break before each -> numbers of its words and marks, and of
        each the place in ``data`` where it begins."""
        raw = np.frombuffer(data, np.uint8)
        space = raw == 32
        cut = np.flatnonzero(space | (raw == 10))
        starts, ends = cut + space[cut], np.append(cut[1:], len(raw))
        # A mark at the end of a word leaves the word.
        long = ends - starts > 1
        last = np.where(long, ends - 1, 0)
        marked = long & _MARK[raw[last]] & _BEFORE_MARK[raw[last - 1]]
        kept = ~space
        kept[last[marked]] = False
        offsets = np.concatenate([[0], np.cumsum(ends - starts - marked)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[kept])])
        code = words.dictionary_encode()
        different = code.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = list(map(self.known.get, different))
        new = [w for w, n in zip(different, numbers) if n is None]
        if new:
            self._learn(new)
            self.long = self.long or max(map(len, new)) > LONGEST
            numbers = [self.known[w] for w in different]
        found = np.array(numbers, np.int64)[code.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.empty(0, np.int64)
        marks = np.flatnonzero(marked)
        at = marks + 1 + np.arange(len(marks))  # marks stand behind their words
        out, places = np.empty(len(found) + len(marks), np.int64), np.empty(len(found) + len(marks), np.int64)
        words_at = np.ones(len(out), bool)
        words_at[at] = False
        out[words_at], places[words_at] = found, cut
        out[at], places[at] = _NUMBER[raw[last[marks]]], last[marks]
        return out, places

    def encode_flat(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); with ``end`` behind each text."""
        regular = [bool(t) and not (any(r in t for r in RUNS) or OTHER_SPACE.search(t) or any(a in t for a in self.added)) for t in texts]
        parts = [b"\n" + t.encode() for t, r in zip(texts, regular) if r]
        lengths = np.array([len(p) for p in parts], np.int64)
        self._prune()
        numbers, places = self._numbers(b"".join(parts))
        np.add.at(self.uses, numbers, 1)
        sizes = self.sizes[numbers]
        total = int(sizes.sum())
        ids = self.ids[_ranges(self.firsts[numbers], sizes)]
        # The line break that stood before each text goes.
        skip, last = len(self.line_break), 0 if end is None else 1
        bounds = np.append(0, np.cumsum(sizes))[np.searchsorted(places, np.append(0, np.cumsum(lengths)))]
        counts = np.zeros(len(texts), np.int64)
        own = np.flatnonzero(regular)
        counts[own] = np.diff(bounds) - skip
        whole = {i: self._ids(t) for i, t in enumerate(texts) if t and not regular[i]}
        for i, x in whole.items():
            counts[i] = len(x)
        counts += last
        out = np.full(int(counts.sum()), end or 0, "<u4")
        firsts = np.cumsum(counts) - counts
        keep = np.ones(total, bool)
        for k in range(skip):
            keep[bounds[:-1] + k] = False
        size = counts[own] - last
        out[_ranges(firsts[own], size)] = ids[keep]
        for i, x in whole.items():
            out[firsts[i] : firsts[i] + len(x)] = x
        return out, counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of every text; none for null and empty texts."""
        ids, counts = self.encode_flat(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)


@cache
def sentence_ends(path: str) -> np.ndarray:
    """For every id, whether its text ends with a full stop, an exclamation or question mark, or a
    line break."""
    inner = word_tokenizer(path).inner
    return np.array([inner.id_to_token(i).endswith((".", "!", "?", "Ċ")) for i in range(inner.get_vocab_size())])
