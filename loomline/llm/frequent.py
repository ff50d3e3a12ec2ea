"""Most frequent items by multi-hash bucket filtering.

Pass 1 counts rows exactly in ``buckets`` coarse buckets under each of several hashes. An item that
makes up a share ``num/den`` of its group lies in buckets that all reach that share, so only items
whose every bucket does are candidates: at most ``den/num`` buckets per hash and group survive,
whatever the number of distinct items. Pass 2 counts the candidates exactly. Memory is bounded by
groups x hashes x buckets; the result holds every frequent item and no other.

Defined cases. Null and empty items are left out of all counts; null groups are left out. Ties and
repeated rows count as they stand. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.runtime import cut, join_small

HASHES, BUCKETS = 3, 1024


def bucket(item: Column, seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(buckets)).cast("int")


def bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(64)))


def word(number: Column) -> Column:
    return F.floor(number / 64).cast("int")


def all_words(some: Column, buckets: int) -> Column:
    """A set of buckets as an array of 64-bit words, from the (word, bits) pairs that are not zero."""
    by_word = F.map_from_entries(some)
    return F.transform(F.sequence(F.lit(0), F.lit(buckets // 64 - 1)), lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(0).cast("bigint")))


def has_bit(words: Column, number: Column) -> Column:
    return F.element_at(words, word(number) + 1).bitwiseAND(bit(number)) != 0


def frequent_items(rows: DataFrame, groups: list[str], item: str, num: int, den: int, hashes: int = HASHES, buckets: int = BUCKETS) -> DataFrame:
    """Items with at least num/den of their group's rows: groups, item, n_rows, group_rows, coarse_bound.

    ``coarse_bound`` is the smallest count of the item's buckets, what pass 1 alone would answer.
    """
    if buckets % 64 or buckets < 2 * den / num:
        raise ValueError("buckets must be a multiple of 64 and at least twice den/num")
    known = F.col(item).isNotNull()
    if dict(rows.dtypes)[item] == "string":
        known = known & (F.length(item) > 0)
    for g in groups:
        known = known & F.col(g).isNotNull()
    items = rows.where(known).select(*groups, F.col(item).alias("item"))
    spots = F.explode(F.array(*[F.struct(F.lit(h).alias("hash"), bucket(F.col("item"), h, buckets).alias("bucket")) for h in range(hashes)]))
    coarse = items.select(*groups, spots.alias("s")).groupBy(*groups, "s.hash", "s.bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*groups, "hash"))
    # at most den/num buckets a hash and group, kept so that pass 1 runs once
    heavy = cut(coarse.withColumn("group_rows", whole).where(F.col("n") * den >= F.col("group_rows") * num))
    sets = heavy.groupBy(*groups, "hash", word(F.col("bucket")).alias("word")).agg(F.bit_or(bit(F.col("bucket"))).alias("bits"), F.max("group_rows").alias("group_rows"))
    found = [F.collect_list(F.when(F.col("hash") == h, F.struct("word", "bits"))).alias(f"h{h}") for h in range(hashes)]
    filters = sets.groupBy(*groups).agg(F.max("group_rows").alias("group_rows"), *found)
    filters = filters.select(*groups, "group_rows", *[all_words(F.col(f"h{h}"), buckets).alias(f"w{h}") for h in range(hashes)])
    tested = join_small(items, filters, groups)
    for h in range(hashes):
        tested = tested.where(has_bit(F.col(f"w{h}"), bucket(F.col("item"), h, buckets)))
    counts = tested.groupBy(*groups, "item").agg(F.count(F.lit(1)).alias("n_rows"), F.max("group_rows").alias("group_rows"))
    exact = counts.where(F.col("n_rows") * den >= F.col("group_rows") * num)
    # few rows from here on: at most den/num items a group
    bound = heavy.select(*groups, "hash", "bucket", "n")
    spots_of = exact.select("*", spots.alias("s")).select(*exact.columns, F.col("s.hash").alias("hash"), F.col("s.bucket").alias("bucket"))
    return spots_of.join(bound, [*groups, "hash", "bucket"]).groupBy(*groups, "item").agg(F.max("n_rows").alias("n_rows"), F.max("group_rows").alias("group_rows"), F.min("n").alias("coarse_bound"))
