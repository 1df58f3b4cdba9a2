"""Token ids of whole texts from a public tokenizer file, inside Arrow tasks.

The tokenizer drops white space before it looks for pairs, so the ids of a text are the ids
of its words in order. Every Python worker has the library encode a distinct word once and
then copies. A word that is Latin letters between ASCII marks is cut there and goes to the library's
pair-merging model directly, which is what the tokenizer would do with it. Marks that end a word
are words of their own, so a word is not new because of the comma behind it.
"""

from __future__ import annotations

import os
import re
import string
from codecs import charmap_decode
from functools import lru_cache

import numpy as np

from reviewmill.llm.words import TABLE_BYTES, WORD_BYTES, segments

MARKS = string.punctuation.replace("'", "")
#: Below this code point no letter joins its neighbour under NFC and lower case is by letter.
PLAIN = "\u0130"


def folded(text: bytes) -> bytes:
    """A-Z in lower case, which the tokenizer does later, unless that could change what it sees:
    a mark after the letter may join it (U+0300 to U+036F), a special token is as written."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


def parts_of(word: str) -> tuple[str, ...] | None:
    """A word as the lower-cased parts that the tokenizer looks at one by one, where that is
    certain: ASCII marks, Latin letters, ASCII marks. None for any other word."""
    if word.isascii() and word.isalpha():
        return (word.lower(),)
    core = word.strip(MARKS)
    if "<|" in word:
        return None
    if not core:
        return (word,)
    if not core.isalpha() or max(core) >= PLAIN:
        return None
    if len(core) == len(word):
        return (core.lower(),)
    at = word.index(core)
    return tuple(x for x in (word[:at], core.lower(), word[at + len(core) :]) if x)


#: ASCII marks from after a letter to the end of a word. The tokenizer cuts before them. Marks that
#: special tokens and contractions are made of are left out.
_LAST_MARKS = re.compile(rb"[!-&(-/:;=?@\[-`{}~](?<=[A-Za-z].)[!-&(-/:;=?@\[-`{}~]*(?=[\x20\x09-\x0D]|\Z)")


def words_of(segment: bytes) -> list[bytes]:
    """The words of a text, and the marks that end them as words of their own."""
    return _LAST_MARKS.sub(rb" \g<0>", segment).split()


class _Rows:
    """Rows of ids of differing length, appended and gathered by number."""

    def __init__(self) -> None:
        self.ids = np.empty(1 << 16, np.uint32)
        self.first = np.zeros(1 << 12, np.int64)
        self.used = 0

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        start, n = int(self.first[self.used]), len(lengths)
        if start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:start], np.empty(start + 2 * len(ids) + 1, np.uint32)])
        self.ids[start : start + len(ids)] = ids
        if self.used + n + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(len(self.first) + n + 1, np.int64)])
        self.first[self.used + 1 : self.used + n + 1] = start + np.cumsum(lengths)
        self.used += n

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after the other, and their lengths."""
        first = self.first[numbers]
        lengths = self.first[numbers + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(first - ends + lengths, lengths) + np.arange(total)], lengths


class _Numbers(dict):
    """Numbers keys as they come; ``fresh`` lists those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Library:
    """The tokenizer of a file, and what is read from it once; of fixed size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        # a letter beyond ASCII meets the model as two stand-ins for its UTF-8 bytes
        letters = [i for i in (0xAA, 0xB5, 0xBA, *range(0xC0, 0x130)) if chr(i).isalpha()]
        self.stand_ins = {i: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(i))[0][0] for i in letters}
        held = {b: c for i, pair in self.stand_ins.items() for b, c in zip(chr(i).encode(), pair, strict=True)}
        self.bytes_as = "".join(held.get(b, chr(b) if b < 0x80 else "\ufffe") for b in range(256))


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


class Encoder:
    """Ids of texts, by distinct word. At TABLE_BYTES it forgets the words that did not come again
    after the segment that brought them, or all, if the others take half of that."""

    def __init__(self, path: str):
        held = library(path)
        self.tokenizer, self.model, self.vocabulary, self.bytes_as = held.tokenizer, held.model, held.vocabulary, held.bytes_as
        self.words, self.word_ids, self.cost = _Numbers(), _Rows(), 0
        self.again = np.zeros(1 << 12, bool)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.again[: len(self.words)])
        names, (ids, lengths) = list(self.words), self.word_ids.gather(kept)
        self.words, self.word_ids, self.cost = _Numbers(), _Rows(), 0
        self.again[:] = False
        names = [names[i] for i in kept.tolist()]
        if self._cost(names, ids) <= TABLE_BYTES // 2:
            self.words.update(zip(names, range(len(names))))
            self.word_ids.append(ids, lengths)
            self.cost = self._cost(names, ids)

    @staticmethod
    def _cost(words: list[bytes], ids: np.ndarray) -> int:
        return WORD_BYTES * len(words) + sum(map(len, words)) + 8 * len(ids)

    def _shown(self, letters: str) -> str:
        """Lower-cased Latin letters as the model meets them, a letter for each byte."""
        return charmap_decode(letters.encode(), "strict", self.bytes_as)[0]

    def _word(self, text: str) -> list[int]:
        parts = parts_of(text)
        if parts is None:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        found = []
        for part in parts:
            found += [token.id for token in self.model.tokenize(part if part.isascii() else self._shown(part))]
        return found

    def _settle(self) -> None:
        """Encode the words that came up since the last call."""
        fresh, self.words.fresh = self.words.fresh, []
        if fresh:
            lengths, flat, tokenize = [], [], self.model.tokenize
            for word in fresh:
                if word.isalpha():  # ASCII
                    new = [token.id for token in tokenize(word.decode().lower())]
                elif (text := word.decode("utf-8", "replace")).isalpha() and max(text) < PLAIN:
                    new = [token.id for token in tokenize(self._shown(text.lower()))]
                else:
                    new = self._word(text)
                lengths.append(len(new))
                flat += new
            ids = np.array(flat, np.uint32)
            self.cost += self._cost(fresh, ids)
            self.word_ids.append(ids, np.array(lengths, np.int64))
            if len(self.words) > len(self.again):
                self.again = np.concatenate([self.again, np.zeros(len(self.words), bool)])

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of one whole text."""
        out = []
        for segment in segments(folded(text)):
            if self.cost > TABLE_BYTES:
                self._forget()
            words, known = words_of(segment), len(self.words)
            numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            self.again[numbers[numbers < known]] = True
            self._settle()
            out.append(self.word_ids.gather(numbers)[0])
        return out[0] if len(out) == 1 else np.concatenate(out)

    def with_end(self, text: bytes, end: int) -> np.ndarray:
        return np.append(self.encode(text), np.uint32(end))


def encoder(path: str) -> Encoder:
    """An encoder for one task. Its words go with it; the worker keeps the tokenizer only."""
    return Encoder(path)
