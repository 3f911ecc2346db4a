"""Membership of requests in an address set that is too large to broadcast.

A Bloom filter of the set is built by one aggregate and checked map-side, so
that only requests of the set's addresses (and a few false positives) are
shuffled to the exact join behind it. The result is that of the plain join.

The filter is a table of 64-bit words. An address hashes to one word and to
``BITS`` bits in it (a register-blocked filter), so building is ``bit_or`` per
word with map-side combine, and checking is one broadcast hash join on the word
number and a mask test, all in generated code. The number of words is bounded
by ``MAX_WORDS``, hence so is what is broadcast (16 bytes a word); the filter of
a larger set lets more requests through and the join stays exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits set for an address, addresses a word is sized for, and words at most (16 MB to broadcast).
BITS = 5
PER_WORD = 4
MAX_WORDS = 1 << 20


def filter_words(expected: int) -> int:
    """Words of a filter for ``expected`` addresses: a power of two."""
    return min(MAX_WORDS, 1 << max(6, (max(1, expected) // PER_WORD).bit_length()))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("long")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])


def bloom_filter(addresses: DataFrame, words: int) -> DataFrame:
    """(word, bits) of the addresses in column ``ip``; at most ``words`` rows."""
    ip = F.col("ip")
    return (addresses.filter(ip.isNotNull()).groupBy(_word(ip, words).alias("_word"))
            .agg(F.bit_or(_mask(ip)).alias("_bits")))


def maybe_in(requests: DataFrame, bloom: DataFrame, words: int) -> DataFrame:
    """Requests whose address may be in the set: all of its addresses, and
    few others. Map-side."""
    ip = F.col("ip")
    j = requests.join(F.broadcast(bloom), _word(ip, words) == F.col("_word"))
    return j.filter(F.col("_bits").bitwiseAND(_mask(ip)) == _mask(ip)).select(*requests.columns)


def surely_not_in(requests: DataFrame, bloom: DataFrame, words: int) -> DataFrame:
    """The other requests, those without an address included."""
    ip = F.col("ip")
    j = requests.join(F.broadcast(bloom), _word(ip, words) == F.col("_word"), "left")
    hit = F.col("_bits").bitwiseAND(_mask(ip)) == _mask(ip)
    return j.filter(~F.coalesce(hit, F.lit(False)) | ip.isNull()).select(*requests.columns)


def _filter_of(suspicious: DataFrame, expected: int | None) -> tuple[DataFrame, int]:
    words = filter_words(suspicious.count() if expected is None else expected)
    return bloom_filter(suspicious.select("ip"), words), words


def suspicious_requests(requests: DataFrame, suspicious: DataFrame, expected: int | None = None) -> DataFrame:
    """Requests made by suspicious addresses: filtered first, then joined
    exactly. ``suspicious`` has one row per address, like every score table; the
    join is an inner one, since the optimizer moves a semi join below the
    filter. ``expected`` is about the number of addresses; it is counted when
    not given."""
    bloom, words = _filter_of(suspicious, expected)
    return maybe_in(requests, bloom, words).join(suspicious.select("ip"), "ip").select(*requests.columns)


def request_suspicious_flag(requests: DataFrame, suspicious: DataFrame, expected: int | None = None) -> DataFrame:
    """Every request with ``is_suspicious``: only those that pass the filter
    meet the set; the others are known not to be in it where they are read."""
    bloom, words = _filter_of(suspicious, expected)
    found = maybe_in(requests, bloom, words).join(suspicious.select("ip", F.lit(True).alias("is_suspicious")), "ip", "left")
    found = found.withColumn("is_suspicious", F.coalesce("is_suspicious", F.lit(False)))
    rest = surely_not_in(requests, bloom, words).withColumn("is_suspicious", F.lit(False))
    return found.select(*requests.columns, "is_suspicious").unionByName(rest)
