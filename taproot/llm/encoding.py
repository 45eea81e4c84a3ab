"""Whole-text encoding by the tokenizers library, with a bounded memo of the ids of words.

The ids are those of the library's plain ``encode(text, add_special_tokens=False)``. Both tokenizers split a text into
pieces before they merge, and never across the cuts made here, so the ids of a text are the ids of its words in
order. Arrow splits the texts of a group into words, numbers the distinct ones and takes their closing punctuation off;
only what is distinct then goes to the memo or the library, and Arrow puts the ids together again. The memo keeps two generations of words, so what is used
often stays when the older one is dropped.

A text that holds the string of a special (added) token is encoded whole by the library, which takes it for that token;
so is every text under a tokenizer whose added tokens match normalised text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in a generation of the memo.
MEMO = 200_000
#: Bytes of text that are encoded at once; a longer text is taken alone.
GROUP = 3_000_000

_LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_MARKS = ".,;:!?%$&*#"
#: The letters of `_LATIN`.
_LATIN_LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isascii() and c.isalpha() or c >= "À" and c not in "×÷")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes as themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_SPACE = _LETTERS[0x20]


def strings(a: pa.Array) -> list[str]:
    """As `to_pylist`, several times faster."""
    return a.to_numpy(zero_copy_only=False).tolist()


class Memo(dict):
    """What ``learn`` gives for each key, kept for the last ``most`` to ``2 * most`` keys asked for."""

    def __init__(self, learn, most: int) -> None:
        super().__init__()
        self.learn, self.most, self.older = learn, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.learn(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found

    def all(self, keys: list[str]) -> list[bytes]:
        """What is known or learned for each of some different keys, without a call for each known one."""
        found: list[bytes] = []
        for at in range(0, len(keys), self.most):
            own = keys[at : at + self.most]
            got = list(map(self.get, own))
            fresh = [i for i, x in enumerate(got) if x is None]
            asked, learn = [own[i] for i in fresh], self.learn
            for i, k, x in zip(fresh, asked, map(self.older.get, asked), strict=True):
                got[i] = learn(k) if x is None else x
            if len(self) + len(asked) > self.most:
                self.older = dict(self)
                self.clear()
            self.update(zip(asked, map(got.__getitem__, fresh), strict=True))
            found += got
        return found


def _binary(found: list[bytes]) -> pa.Array:
    return pa.array(found, pa.large_binary())


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    Words of Latin-1 letters and plain punctuation go to the library's model directly, letters and punctuation apart,
    as the two never merge. All others go through the library's whole tokenizer.
    """

    def __init__(self, path: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.codes = [i.to_bytes(4, "little") for i in range(self.size())]
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.always_whole = any(t.normalized for t in added)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters, self.others = Memo(self._merged, memo), Memo(self.whole, memo // 10)

    def size(self) -> int:
        """All ids are less than this."""
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1

    def _merged(self, letters: str) -> bytes:
        as_bytes = letters.replace(" ", _SPACE) if letters.isascii() else letters.encode().decode("latin-1").translate(_LETTERS)
        codes = self.codes
        return b"".join([codes[t.id] for t in self.tokenize(as_bytes)])

    def whole(self, text: str) -> bytes:
        codes = self.codes
        return b"".join([codes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(lists of words, which texts can't be split)."""
        raise NotImplementedError

    def _letters(self, words: pa.Array) -> pa.Array:
        """What the model takes for words of letters only."""
        raise NotImplementedError

    def _other(self, word: str) -> bytes:
        return self.others[word]

    def _first(self, word: str) -> bytes:
        """The first word of a text."""
        return self._other(word)

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words."""
        own = pc.utf8_rtrim(words, _MARKS)
        plain = pc.match_substring_regex(own, _LATIN)
        numbered = self._letters(own.filter(plain)).dictionary_encode()
        # Before the marks a plain word has letters only.
        marks = pc.utf8_ltrim(words.filter(plain), _LATIN_LETTERS).dictionary_encode()
        known, closing = _binary(self.letters.all(strings(numbered.dictionary))), _binary([self.letters[m] if m else b"" for m in strings(marks.dictionary)])
        joined = pc.binary_join_element_wise(known.take(numbered.indices), closing.take(marks.indices), pa.scalar(b"", pa.large_binary()))
        is_plain = plain.to_numpy(zero_copy_only=False)
        others = _binary([self._other(w) for w in strings(words.filter(pc.invert(plain)))])
        places = np.where(is_plain, np.cumsum(is_plain) - 1, len(joined) + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([joined, others]).take(pa.array(places))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[bytes, np.ndarray]:
        """(the ids of all texts in a row, how many each has), with ``end_id`` after each text. Null texts count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.full(len(texts), self.always_whole)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        lists, unfit = self._split(texts)
        odd |= unfit
        if odd.any():
            # They are encoded whole, below.
            lists, _ = self._split(pc.if_else(pa.array(odd), "", texts))
        words = lists.flatten()
        ends = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        starts = (np.concatenate([[0], ends[:-1]])).astype(np.int64)[: len(ends)]
        numbered = words.dictionary_encode()
        index, distinct = numbered.indices.to_numpy().copy(), len(numbered.dictionary)
        # The first word of each text is looked up by itself: it may differ, or stand for the whole text.
        index[starts] = distinct + np.arange(len(starts))
        firsts = [self._first(w) for w in strings(words.take(pa.array(starts)))]
        for i in np.flatnonzero(odd).tolist():
            firsts[i] = self.whole(texts[i].as_py())
        found = pa.concat_arrays([self._words(numbered.dictionary), _binary([*firsts, end_id.to_bytes(4, "little")])])
        order = np.insert(index, ends, distinct + len(firsts))
        _, offsets, codes = found.take(pa.array(order)).buffers()
        upto = np.frombuffer(offsets, np.int64)[ends + np.arange(len(ends)) + 1] // 4
        return codes.to_pybytes()[: 4 * int(upto[-1])] if len(upto) else b"", np.diff(upto, prepend=0)


class LoweredWords(Encoder):
    """For a tokenizer that lowers letters and drops white space: a text is cut at every space and newline."""

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), np.zeros(len(texts), bool)

    def _letters(self, words: pa.Array) -> pa.Array:
        return pc.utf8_lower(words)


class SpacedWords(Encoder):
    """For a byte-level tokenizer whose pieces may begin with one space.

    A single space or newline between two characters that aren't white space always begins a piece, and a newline there
    is a piece of its own. Texts with other white space are encoded whole.
    """

    _UNFIT = r"[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"

    def __init__(self, path: str, memo: int = MEMO) -> None:
        super().__init__(path, memo)
        self.newline = self.whole("\n")

    def _other(self, word: str) -> bytes:
        # A word after a newline keeps it, so that it is told from one after a space.
        return self.newline + self.others[word[1:]] if word[:1] == "\n" else self.others[" " + word]

    def _first(self, word: str) -> bytes:
        return self.others[word]

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        unfit = pc.match_substring_regex(texts, self._UNFIT).to_numpy(zero_copy_only=False)
        return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "), unfit

    def _letters(self, words: pa.Array) -> pa.Array:
        large = lambda x: pa.scalar(x, pa.large_string())
        return pc.binary_join_element_wise(large(" "), words, large(""))


def groups(batch: pa.RecordBatch, column: int, size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text in a column each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(first, last - first)
        first = last


_encoders: dict[tuple[str, type], Encoder] = {}


def encoder(path: str, kind: type[Encoder]) -> Encoder:
    """One encoder per worker process."""
    key = (path, kind)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = kind(path)
    return _encoders[key]
