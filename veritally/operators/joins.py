"""Key filters.

Three steps of one question, "which rows have a key in that table?", at any size of either:

- few keys: Spark broadcasts them, and no row of the wide side moves;
- more keys than Spark broadcasts: a Bloom filter of fixed size goes to the scan first, so that only
  rows that may match are exchanged, payload and all; the exact join follows;
- so many keys that the filter is full: every row passes it, and the exact join does the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a filter: 8 MB, one in 30 of the other rows passes at 6 million keys.
FILTER_WORDS = 1 << 20
_BITS = 4  # of a word that a key sets


def bloom_filter(keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """`word` and `bits`: a Bloom filter of all key columns, with at most `words` rows however many
    keys there are. A key sets some bits of one word; words add up map-side by OR."""
    _check(words)
    word, mask = _place([F.col(f"`{c}`") for c in keys.columns], words)
    present = keys.where(_present(keys.columns))
    return present.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def may_have_key(df: DataFrame, on: list[str], bits: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose key the filter does not rule out. The filter is broadcast: `words` bounds it.
    Rows are tested where they are scanned."""
    _check(words)
    word, mask = _place([F.col(f"`{c}`") for c in on], words)
    held = F.broadcast(bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    # A semi-join: Spark moves the exact one that follows below an inner join, but not below this.
    passes = (F.col("_word") == word) & (F.col("_bits").bitwiseAND(mask) == mask)
    return df.where(_present(on)).join(held, passes, "left_semi")


def restrict_to_keys(df: DataFrame, keys: DataFrame, *, words: int | None = None) -> DataFrame:
    """The rows of `df` whose key is in `keys`, whatever the size of either.

    A left-semi join. If Spark's estimate of the keys is beyond what it broadcasts, so that the join
    would exchange `df`, a Bloom filter drops most other rows at the scan. `words` is the size of
    that filter and asks for it whatever the estimate; 0 leaves it out. The rows are the same in
    any case: the filter drops no row with a key, and the join decides.
    """
    columns = keys.columns
    if words is None:
        words = 0 if _is_broadcast(keys) else FILTER_WORDS
    if words:
        df = may_have_key(df, columns, bloom_filter(keys, words), words)
    return df.join(keys.where(_present(columns)), columns, "left_semi")


def _check(words: int) -> None:
    if words < 1 or words & (words - 1) or words > 1 << 22:
        raise ValueError("a filter has a power of two of words, 2**22 at most")


def _present(columns: list[str]) -> str:
    return " AND ".join(f"`{c}` IS NOT NULL" for c in columns)


def _place(key: list[Column], words: int) -> tuple[Column, Column]:
    """Word of a key and the bits it sets there, from two hashes."""
    word = F.xxhash64(F.lit("word"), *key).bitwiseAND(F.lit(words - 1))
    other = F.xxhash64(F.lit("bits"), *key)
    mask = F.lit(0).cast("long")
    for k in range(_BITS):
        at = F.shiftrightunsigned(other, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return word, mask


def _is_broadcast(keys: DataFrame) -> bool:
    """Whether Spark, by its own estimate, broadcasts a table of these keys."""
    frame = keys._jdf
    size = int(frame.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= frame.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
