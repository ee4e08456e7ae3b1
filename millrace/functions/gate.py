"""The full proof that a candidate keeps its source's placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import PLACEHOLDER, tokens

CONVERSION = r"%\d+\$[sdif]|%[sdif]"


def indexed_equivalent(source: Column, target: Column) -> Column:
    """Whether the target spells the source's plain conversions by index: as many, each index once, each of the type of
    the argument that it names."""
    s, t = tokens(source, CONVERSION), tokens(target, CONVERSION)
    n = F.size(s)
    index = F.transform(t, lambda x: F.regexp_extract(x, r"^%(\d+)\$", 1))
    plain = F.forall(s, lambda x: F.length(x) == 2)
    permutation = F.array_sort(F.transform(index, lambda x: x.try_cast("int"))) == F.sequence(F.lit(1), n)
    typed = F.forall(
        F.arrays_zip(index.alias("i"), t.alias("c")),
        lambda x: F.right(x["c"], F.lit(1)) == F.right(F.get(s, x["i"].try_cast("int") - 1), F.lit(1)),
    )
    return (n > 0) & plain & (F.size(t) == n) & F.coalesce(permutation, F.lit(False)) & F.coalesce(typed, F.lit(False))


def placeholders_match(source: Column, target: Column) -> Column:
    """Equal multisets of placeholders, or equal but for conversions that are proven equivalent."""
    s, t = F.array_sort(tokens(source, PLACEHOLDER)), F.array_sort(tokens(target, PLACEHOLDER))
    other = lambda x: F.filter(x, lambda p: ~p.rlike(f"^(?:{CONVERSION})$"))
    return (s == t) | (indexed_equivalent(source, target) & (other(s) == other(t)))
