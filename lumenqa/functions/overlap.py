"""Token overlap and longest-common-subsequence scores of answers, each in two families that never mix.

squad: normalised tokens (articles and punctuation out). plain: lower-case white-space tokens, punctuation and tags kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lumenqa.functions import text as T


def tokens(x: Column, family: str) -> Column:
    return T.split_words(T.squad_normalised(x) if family == "squad" else F.lower(T.text_or_empty(x)))


def common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    kinds = F.array_intersect(a, b)
    times = lambda x, t: F.size(x) - F.size(F.array_remove(x, t))
    return F.aggregate(kinds, F.lit(0), lambda n, t: n + F.least(times(a, t), times(b, t)))


def f1_of(shared: Column, n: Column, m: Column) -> Column:
    p, r = shared / n, shared / m
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (shared == 0), 0.0).otherwise(2 * p * r / (p + r))


def bound(a: Column, b: Column, build) -> Column:
    """build(a, b) with each argument evaluated once, however often build uses it."""
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: build(s["a"], s["b"]))[0]


def token_f1(gold: Column, answer: Column, family: str) -> Column:
    """Both empty 1, one empty 0, nothing shared 0."""
    return bound(tokens(gold, family), tokens(answer, family), lambda a, b: f1_of(common(a, b), F.size(a), F.size(b)))


def lcs_length(a: list[str], b: list[str]) -> int:
    """By bit-parallel rows: one big-integer step per token."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        match = row & where.get(t, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count() if a else 0


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def rouge_l(gold: Column, answer: Column, family: str) -> Column:
    """squad: any side empty 0. plain: both empty 1, one empty 0."""
    a, b = tokens(gold, family), tokens(answer, family)
    n, m = F.size(a), F.size(b)
    shared = lcs(a, b)
    p, r = shared / m, shared / n
    empty = F.lit(0.0) if family == "squad" else F.when((n == 0) & (m == 0), 1.0).otherwise(0.0)
    return F.when((n == 0) | (m == 0), empty).when(shared == 0, 0.0).otherwise(2 * p * r / (p + r))

