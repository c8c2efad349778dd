"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import words_of

DIMENSIONS = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.try_divide(dot(a, b), norm))


def bucket(word: Column) -> Column:
    """A bucket that is the same in every process: from the first 7 hex digits of md5."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long") % DIMENSIONS


def buckets(text: Column) -> Column:
    """Bucket of each word, with repeats: the sparse form of the hashed bag of words."""
    return F.transform(words_of(F.lower(text)), bucket)


def bag(text: Column) -> Column:
    """Sorted buckets of the words, with repeats."""
    return F.array_sort(buckets(text))


def _squares(sorted_bag: Column) -> Column:
    """Sum of squared counts of a sorted bag: one pass with the length of the current run, since k^2 = 1 + 3 + ... + (2k-1)."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1.0).otherwise(1.0)
        return F.struct(x.alias("last"), run.alias("run"), (s["sum"] + 2.0 * run - 1.0).alias("sum"))

    return F.aggregate(sorted_bag, start, step)["sum"]


def norm(sorted_bag: Column) -> Column:
    return F.sqrt(_squares(sorted_bag))


def weights(sorted_bag: Column) -> Column:
    """Bucket -> count, to be built once per query."""
    times = lambda k: F.size(F.filter(sorted_bag, lambda x: x == k)).cast("double")
    return F.map_from_entries(F.transform(F.array_distinct(sorted_bag), lambda k: F.struct(k, times(k))))


def bag_cosine(sorted_bag: Column, query_weights: Column, query_norm: Column) -> Column:
    """Cosine of a bag and a query's weights; 0 where either is empty.  The arguments should be columns, not expressions."""
    dot_ = F.aggregate(sorted_bag, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(query_weights, x), F.lit(0.0)))
    both = norm(sorted_bag) * query_norm
    return F.when(both == 0, 0.0).otherwise(F.try_divide(dot_, both))
