"""Column expressions: splits, text hygiene, hashes as longs, rounding as Python rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Top folders that name a split; anything else belongs to ``all``.
SPLITS = ("train", "test", "val", "valid", "validation")
OTHER_SPLIT = "all"
#: How findings rank and what they cost.
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}
SEVERITY_WEIGHT = {"error": 15, "warning": 5, "info": 1}


def split_of(rel: Column) -> Column:
    """The split of a path relative to the root."""
    first = F.lower(F.element_at(F.split(rel, "/"), 1))
    return F.when(first.isin(*SPLITS), first).otherwise(F.lit(OTHER_SPLIT))


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end; null becomes the empty string."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sequence_dhash(values: Column, n: int) -> Column:
    """A hash of n numbers: bit i (from the highest of n - 1) says that the next number is larger."""
    if not 2 <= n <= 65:
        raise ValueError("2 to 65 numbers make a hash of a long")
    out = F.lit(0).cast("long")
    for i in range(n - 1):
        bit = F.when(F.element_at(values, i + 2) > F.element_at(values, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("long")
        out = out.bitwiseOR(F.shiftleft(bit, n - 2 - i))
    return out


def degenerate_kind(pmin: Column, pmax: Column) -> Column:
    """What is wrong with an image of these grey extremes; null if it has any contrast (or no extremes)."""
    flat = F.when(pmax == 0, "all_black").when(pmax == 255, "all_white").otherwise("constant")
    return F.when(pmin == pmax, flat)


def ratio4(count: Column, total: Column) -> Column:
    """count / total to four places, ties to even."""
    return F.bround(count / total, 4)


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def severity_weight(severity: Column) -> Column:
    out = F.lit(1)
    for name, weight in SEVERITY_WEIGHT.items():
        out = F.when(severity == name, F.lit(weight)).otherwise(out)
    return out


def shortened(text: Column, limit: int = 90) -> Column:
    """At most ``limit`` characters, the last three of a longer text being dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def listed(files: Column, limit: int, more: str) -> Column:
    """The first ``limit`` files, and how many more there are (``more`` has one %d)."""
    shown = F.concat_ws(", ", F.slice(files, 1, limit))
    return F.when(F.size(files) > limit, F.concat(shown, F.format_string(more, F.size(files) - limit))).otherwise(shown)
