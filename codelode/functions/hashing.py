"""Hashes of token streams (T1-T3, T14). All are JVM expressions; none re-evaluates its input per element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32-bit FNV-1a offset and prime, the code point that ends a token, and the sketch's size and gram width.
FNV_OFFSET, FNV_PRIME, TOKEN_END = 0x811C9DC5, 0x01000193, 31
SKETCH_SIZE, GRAM, SKETCH_FLOOR = 24, 4, 12
MASK32 = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """body(value), value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a BIGINT."""
    step = lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME).cast("long") % F.lit(1 << 32)
    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.lit(FNV_OFFSET).cast("long"), step)


def fnv1a_tokens(tokens: Column) -> Column:
    """FNV-1a of a token array; the end of each token is one more code point (31)."""
    return fnv1a(F.concat(F.array_join(tokens, chr(TOKEN_END)), F.when(F.size(tokens) > 0, F.lit(chr(TOKEN_END))).otherwise(F.lit(""))))


def md5_int(text: Column) -> Column:
    """The leading 60 bits of MD5, a hash that SQL engines agree on."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def grams(tokens: Column, n: int = GRAM) -> Column:
    """The n-grams of a token array, joined by |; none if it is shorter."""

    def build(t):
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws("|", *[F.get(t, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return let(tokens, build)


def sketch(tokens: Column, hasher=md5_int, k: int = SKETCH_SIZE) -> Column:
    """Bottom-k sketch: the k least distinct hashes of the 4-grams, ascending; NULL below 12 tokens (not indexed is not empty)."""

    def build(t):
        return F.when(F.size(t) >= SKETCH_FLOOR, F.slice(F.array_sort(F.array_distinct(F.transform(grams(t), lambda g: hasher(g)))), 1, k))

    return let(tokens, build)


def content_hash(text: Column, hexes: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, hexes)
