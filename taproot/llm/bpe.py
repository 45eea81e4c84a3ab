"""BPE encoding by forced-boundary splitting, and decoding.

A pair of bytes that stands side by side inside no token of the vocabulary can't be merged over, whatever surrounds it: between the two
there is a certain cut. White space stands in no token, so a text is first cut at every space and newline. The distinct pieces
are split into words by the tokenizer's own rules; then a table of 256 x 256 byte pairs cuts all of them at once, wherever no
token reaches over. The fragments are merged independently of each other, lowest rank first, and their ids concatenated. A
word's last fragment keeps the space after the word, which stands for the vocabulary's mark of a word's end. What is distinct is
merged once: fragments are kept in a bounded memo.

Strings of added (special) tokens in a text are those tokens, as in the library's plain encode. Decoding looks up each id's
string and joins them by spaces, as the library does for a tokenizer without a decoder.

Nothing is shuffled, and a rerun of a lost task gives the same rows. Null texts count as empty, empty and white texts have no
ids, very long texts are taken whole (a task's memory follows its longest text), merges of equal rank (ties) go from left to
right, repeated rows give equal rows, an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.encoding import _LATIN, _LETTERS, _MARKS, Memo, encoder, groups, strings

#: Longer pieces and fragments aren't kept, and longer fragments are merged by a heap.
KEPT = 256

#: Bytes of text that are encoded at once, and of ids that are decoded at once; a longer row is taken alone.
GROUP = 4_000_000
#: Fragments in a generation of the memo.
FRAGMENTS = 200_000

_SPACE = 0x20
_BYTES = {ord(letter): byte for byte, letter in _LETTERS.items()}
_NEVER = 1 << 60
_BEFORE_MARKS = rf"^([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(_MARKS)}]+)$"


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


class ForcedBoundaries:
    """Encodes with the BPE vocabulary of a tokenizer file that has an end-of-word suffix and byte letters."""

    def __init__(self, path: str, memo: int = FRAGMENTS) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file["added_tokens"]
        unfit = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        unfit += [t["content"] for t in added if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or unfit or file["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError(f"not a tokenizer that forced boundaries are made for: {unfit}")
        whole = Tokenizer.from_file(path)
        self.normalized, self.words = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = [_LETTERS[b] for b in range(256)]
        if missing := [x for letter in letters for x in (letter, letter + end) if x not in ids]:
            raise ValueError(f"bytes without a token: {missing}")
        self.inner, self.last = [ids[x] for x in letters], [ids[x + end] for x in letters]
        self.special = {t["content"]: t["id"] for t in added}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {ids[a] * self.size + ids[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.joined = self._joined(ids, end)
        self.fragments, self.split = Memo(self._merged, memo), Memo(self._split, memo // 4)

    @staticmethod
    def _joined(tokens: dict[str, int], end: str) -> np.ndarray:
        """Whether a pair of bytes stands inside any token; a word's last byte and the space after it count as one."""
        found = np.zeros((256, 256), bool)
        for token in tokens:
            own = [_BYTES[ord(c)] for c in token.removesuffix(end)]
            found[own[:-1], own[1:]] = True
        if found[[_SPACE, 0x0A]].any() or found[:, [_SPACE, 0x0A]].any():
            raise ValueError("white space inside a token")
        found[:, _SPACE], found[_SPACE, _SPACE] = True, False
        return found

    def _merged(self, fragment: bytes) -> bytes:
        """The ids of a fragment: the pair of lowest rank, leftmost first, is merged until none is left."""
        own = fragment.removesuffix(b" ")
        parts = [self.inner[b] for b in own]
        if len(own) < len(fragment):
            parts[-1] = self.last[own[-1]]
        if len(parts) >= KEPT:
            return np.array(self._merged_by_heap(parts), "<u4").tobytes()
        get, size, made = self.rank.get, self.size, self.made
        ranks = [get(a * size + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NEVER:
            i = ranks.index(least)
            parts[i : i + 2] = (made[least],)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] * size + parts[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(parts[i] * size + parts[i + 1], _NEVER)
        return b"".join([i.to_bytes(4, "little") for i in parts])

    def _merged_by_heap(self, parts: list[int]) -> list[int]:
        """The same for a long fragment, in O(n log n): neighbours are linked, and a heap holds the pairs by rank and place."""
        get, size, made, n = self.rank.get, self.size, self.made, len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), -1
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # merged otherwise meanwhile
            parts[i], parts[j], after[i] = made[r], gone, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(parts[x] * size + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p != gone]

    def _split(self, piece: str) -> bytes:
        """The words of a piece by the tokenizer's own rules, with a space after each."""
        return b"".join(w.translate(_BYTES).encode("latin-1") + b" " for w, _ in self.words(self.normalized(piece)))

    def _cut(self, words: pa.Array) -> list[bytes]:
        """The ids of strings of words that have a space after each, cut where no token can reach over."""
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = bytes(memoryview(words.buffers()[2] or b"")[offsets[0] : offsets[-1]])
        own = np.frombuffer(data, np.uint8)
        cuts = np.concatenate([[0], np.flatnonzero(~self.joined[own[:-1], own[1:]]) + 1, [len(own)]]) if len(own) else np.zeros(1, np.int64)
        at, known = cuts.tolist(), self.fragments
        ids = [known[data[a:b]] if b - a < KEPT else self._merged(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
        firsts = np.searchsorted(cuts, offsets - offsets[0]).tolist()
        return [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(firsts, firsts[1:], strict=False)]

    def _ids(self, pieces: pa.Array) -> list[bytes]:
        """The ids of distinct pieces. Latin letters and closing marks are two words; the tokenizer splits all other pieces."""
        plain = pc.match_substring_regex(pc.utf8_rtrim(pieces, _MARKS), _LATIN)
        own = pc.replace_substring_regex(pc.utf8_lower(pieces.filter(plain)), _BEFORE_MARKS, r"\1 \2")
        easy = self._cut(pc.binary_join_element_wise(own, _large(" "), _large("")))
        odd, split = strings(pieces.filter(pc.invert(plain))), self.split
        hard = self._cut(pa.array([split[p] if len(p) < KEPT else self._split(p) for p in odd], pa.large_binary()))
        found, is_plain = [b""] * len(pieces), plain.to_numpy(zero_copy_only=False)
        for which, ids in ((is_plain, easy), (~is_plain, hard)):
            for i, x in zip(np.flatnonzero(which).tolist(), ids, strict=True):
                found[i] = x
        return found

    def _mixed(self, text: str) -> bytes:
        """The ids of a text that holds added tokens; the longest of those that begin at a place counts."""
        longest = sorted(self.special, key=len, reverse=True)
        parts = re.split(f"({'|'.join(map(re.escape, longest))})", text)
        words = iter(self._cut(pa.array([self._split(p) for p in parts[::2]], pa.large_binary())))
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else next(words) for i, p in enumerate(parts))

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """(the ids of all texts in a row as little-endian unsigned 32-bit integers, how many each text has)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        mixed = np.zeros(len(texts), bool)
        for s in self.special:
            mixed |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(mixed), _large(""), texts) if mixed.any() else texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        numbered = lists.flatten().dictionary_encode()
        known = self._ids(numbered.dictionary)
        index = numbered.indices.to_numpy().astype(np.int64)
        for i in np.flatnonzero(mixed).tolist():  # its only piece so far is an empty one
            index[ends[i]] = len(known)
            known.append(self._mixed(texts[i].as_py()))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        upto = np.concatenate([[0], np.cumsum(sizes[index])])
        return b"".join(map(known.__getitem__, index.tolist())), np.diff(upto[ends])


class Decoder:
    """Decodes with the vocabulary of a tokenizer file that has no decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["decoder"]:
            raise ValueError("a tokenizer with a decoder of its own")
        known = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.spaced = pa.array([known.get(i, "") + " " for i in range(max(known) + 1)], pa.large_string())

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The text, in UTF-8, of each run of ``sizes`` ids."""
        found = self.spaced.take(pa.array(ids))
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
        data, at = memoryview(found.buffers()[2] or b""), np.concatenate([[0], np.cumsum(sizes)])
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist(), strict=True)]


def _each(docs: DataFrame, schema: str, solve) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in groups(b, 1, GROUP):
                yield solve(g)

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of (doc_id, text); ids are little-endian unsigned 32-bit integers in a row."""

    def solve(g: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes = encoder(tokenizer, ForcedBoundaries).encode(g.column(1))
        ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
        rows = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([g.column(0), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return _each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_tokens long, ids binary", solve)


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids)."""

    def solve(g: pa.RecordBatch) -> pa.RecordBatch:
        ids = g.column(1)
        sizes = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        flat = np.frombuffer(b"".join(x or b"" for x in ids.to_pylist()), "<u4")
        texts = encoder(tokenizer, Decoder).decode(flat, sizes)
        return pa.RecordBatch.from_arrays([g.column(0), ids, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return _each(rows.select("doc_id", "ids"), "doc_id long, ids binary, decoded string", solve)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    made = decoded(encoded(common.table(spark, sf_dir, "documents"), path), path)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return made.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
