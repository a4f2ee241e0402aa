"""N-grams and set similarities as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a lambda's free expressions are computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column, first: int = 0) -> Column:
    """first .. first + n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(first), n + (first - 1))).otherwise(F.array().cast("array<int>"))


def characters(text: Column) -> Column:
    """The code points of a text; splitting once keeps n-grams linear in its length."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def char_grams(text: Column, n: int = 4) -> Column:
    """All character n-grams in order, with repeats; a shorter non-empty text is its own."""
    def of(c: Column) -> Column:
        grams = F.transform(indices(F.size(c) - (n - 1)), lambda i: F.concat(*[F.get(c, i + j) for j in range(n)]))
        short = F.when(F.size(c) > 0, F.array(F.array_join(c, ""))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(c) >= n, grams).otherwise(short)

    return let(characters(text), of)


def char_gram_set(text: Column, n: int = 4) -> Column:
    """Distinct n-grams of a text without its white space."""
    return F.array_distinct(char_grams(F.regexp_replace(text, r"\s+", ""), n))


def word_grams(tokens: Column, least: int = 3, most: int = 5) -> Column:
    """Word n-grams of every length in the range, joined by blanks."""
    def of(t: Column, n: int) -> Column:
        return F.transform(indices(F.size(t) - (n - 1), 1), lambda i: F.array_join(F.slice(t, i, n), " "))

    return let(tokens, lambda t: F.concat(*[of(t, n) for n in range(least, most + 1)]))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common elements per element of the smaller set; 0 if either is empty. The arrays hold distinct elements."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, in code points."""
    x, y = characters(a), characters(b)
    same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def prefix_score(line: Column, query: Column, bonus: float = 0.2) -> Column:
    """Common prefix per character of the query, plus a bonus if the first words agree, at most 1."""
    share = F.when(F.length(query) > 0, common_prefix(line, query) / F.length(query)).otherwise(F.lit(0.0))
    same = F.split(line, " ")[0] == F.split(query, " ")[0]
    return F.least(F.lit(1.0), share + F.when((F.length(query) > 0) & same, bonus).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Inner product in double precision; the cosine for normalised vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x))


def normalized(a: Column, floor: float = 1e-9) -> Column:
    """The vector at length 1; unchanged below the floor."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > floor, x.cast("double") / n).otherwise(x.cast("double")))


def skeleton_match(a: Column, b: Column) -> Column:
    """Struct (match, part): equal, one within the other, or equally long (two at least) with one edit."""
    filled = (a != "") & (b != "")
    inside = filled & (a != b) & (F.contains(a, b) | F.contains(b, a))
    near = filled & (F.length(a) == F.length(b)) & (F.length(a) >= 2) & (F.levenshtein(a, b) <= 1)
    return F.struct((filled & (a == b) | inside | near).alias("match"), inside.alias("part"))


def any_of(conditions) -> Column:
    return reduce(lambda x, y: x | y, conditions)
