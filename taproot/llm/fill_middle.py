"""Fill-in-middle transformation by bit-parallel arithmetic on big integers.

A text is cut into tokens: a run of word characters with the white space (space, tab to carriage return) before it, and what white
space is left at the end. ``bytes.translate`` writes a digit per byte that tells its class, and the digits become one big
integer with a bit per byte, the first byte lowest. A token ends where a set bit's neighbour is unset: ``mask & ~(mask >> 1)``
marks all ends of a text at once. ``bit_count`` gives the number of tokens, and the place of the k-th end is found by halving
the mask and counting one half, again and again, which takes time in proportion to the text. White space is ASCII, so cuts
between bytes are cuts between code points; code points are counted on a mask of the bytes that begin one.

Which texts are transformed, how, and where they are cut follows from the SHA-256 of seed and doc_id alone, so a rerun of a
lost task gives the same rows. Nothing is shuffled.

Null texts count as empty and empty texts stay plain, a null doc_id counts as an empty string in the hash, texts that hold a sentinel
stay plain, very long texts are taken whole (a task holds a few copies of its longest text), equal cuts (ties) leave the middle
empty, repeated rows give equal rows, an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.encoding import groups

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80

_SPACES = b" \t\n\v\f\r"
_WORD = bytes(0x30 + (b not in _SPACES) for b in range(256))
_BEGINS = bytes(0x30 + (not 0x80 <= b < 0xC0) for b in range(256))

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def mask(text: bytes, digits: bytes) -> int:
    """An integer whose bit i is the class of byte i."""
    return int(text.translate(digits)[::-1] or b"0", 2)


def token_ends(text: bytes) -> int:
    """Bit i is set where byte i is the last of a token."""
    words = mask(text, _WORD)
    ends = words & ~(words >> 1)
    return ends | 1 << len(text) - 1 if text[-1:] in _SPACES and text else ends


def select(bits: int, k: int, size: int) -> int:
    """The place of the k-th set bit, from 0, of an integer of ``size`` bits."""
    at = 0
    while size > 1:
        half = size >> 1
        low = bits & (1 << half) - 1
        below = low.bit_count()
        if k < below:
            bits, size = low, half
        else:
            bits, size, k, at = bits >> half, size - half, k - below, at + half
    return at


def cut(text: bytes, first: int, second: int) -> tuple[int, int, int]:
    """(number n of tokens, bytes before the cuts after first % (n + 1) and second % (n + 1) tokens, in order)."""
    ends = token_ends(text)
    n = ends.bit_count()
    places = sorted((first % (n + 1), second % (n + 1)))
    return n, *(select(ends, k - 1, len(text)) + 1 if k else 0 for k in places)


def transformed(text: bytes, digest: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, code points of the prefix, of the middle, output)."""
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= rate or any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return token_ends(text).bit_count() if text else 0, "plain", None, None, text
    n, a, b = cut(text, h1, h2)
    begins = mask(text, _BEGINS)
    upto_a, upto_b = ((begins & (1 << x) - 1).bit_count() for x in (a, b))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < suffix_first:
        return n, "spm", upto_a, upto_b - upto_a, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", upto_a, upto_b - upto_a, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for g in groups(b, 1):
                texts, digests = g.column(1).to_pylist(), g.column(2).to_pylist()
                rows = [transformed(t, d, rate, suffix_first) for t, d in zip(texts, digests, strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([g.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.sha2(key, 256).alias("digest"))
    return rows.mapInArrow(each, SCHEMA).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A transformed text holds no sentinel, so each occurs once in its output."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
tokens AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM hashed),
cuts AS (
  SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens),
parts AS (
  SELECT *, array_to_string(t[:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
