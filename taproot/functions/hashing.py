"""FNV-1a 64: of short strings as column expressions, in two 32-bit halves so that no long overflows, and by Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: the offset basis in two halves; the prime is 2^40 + 435.
_HIGH, _LOW, _PRIME_LOW = 3421674724, 2216829733, 435


def fnv1a64(text: Column) -> Column:
    """struct(hi, lo) of the UTF-8 bytes; null stays null. Each byte is an array's item: for grams and the like."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(digits) / 2).cast("int")
    codes = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(digits, i * 2 - 1, 2), 16, 10).cast("long")))
    start = F.struct(F.lit(_HIGH).cast("long").alias("hi"), F.lit(_LOW).cast("long").alias("lo"))

    def step(acc: Column, b: Column) -> Column:
        x = acc["lo"].bitwiseXOR(b)
        carry = F.shiftright(x * _PRIME_LOW, 32)
        hi = (acc["hi"] * _PRIME_LOW + carry + F.shiftleft(x, 8)).bitwiseAND(0xFFFFFFFF)
        return F.struct(hi.alias("hi"), (x * _PRIME_LOW).bitwiseAND(0xFFFFFFFF).alias("lo"))

    return F.aggregate(codes, start, step)


def _hex_of(texts: pd.Series) -> pd.Series:
    """Hashes of a batch, byte by byte over all of its strings at once; the longest come first, so that those with a
    byte at a place are a prefix."""
    raw = [None if t is None else t.encode() for t in texts]
    order = sorted((i for i, r in enumerate(raw) if r is not None), key=lambda i: -len(raw[i]))
    lengths = np.array([len(raw[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    h = np.full(len(order), (_HIGH << 32) + _LOW, np.uint64)
    prime, up = np.uint64((1 << 40) + _PRIME_LOW), -lengths
    for at in range(int(lengths[0]) if len(order) else 0):
        n = int(np.searchsorted(up, -at))
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * prime
    out: list[str | None] = [None] * len(raw)
    for i, value in zip(order, h.tolist(), strict=True):
        out[i] = f"{value:x}"
    return pd.Series(out, dtype=object)


def fnv1a64_hex(text: Column) -> Column:
    """Lower hex without padding; null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return _hex_of(texts)

    return of(text)


def finding_fingerprint(rule: Column, path: Column, line: Column, column: Column, message: Column) -> Column:
    return fnv1a64_hex(F.concat_ws("|", rule, path, line.cast("string"), column.cast("string"), message))


def content_fingerprint(source: Column, salt: str = "") -> Column:
    """SHA-256 of the content and the salt, with the content's length in bytes."""
    return F.concat(F.sha2(F.concat(source, F.lit(salt)).cast("binary"), 256), F.lit("-"), F.octet_length(source).cast("string"))
