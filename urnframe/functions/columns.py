"""Column builders shared by the operators: hashing, combinatorics, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def long(c: Column | str) -> Column:
    return col(c).cast("long")


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def quantize(c: Column | str, digits: int = 8) -> Column:
    """Fixed-point form of a metric, ready for storage."""
    return F.round(col(c), digits).cast(f"decimal(20,{digits})")


def hash_text(*parts: Column) -> Column:
    """md5 of the parts joined by ``|``: the only source of randomness in the package.

    It depends on the values alone, so a result never depends on partitioning or on retries.
    """
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_int(*parts: Column) -> Column:
    """First 32 bits of :func:`hash_text` as a bigint."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """Uniform double in [0, 1) from :func:`hash_int`."""
    return hash_int(*parts) / F.lit(4294967296.0)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double; 0 when k is negative or above n."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    product = F.aggregate(
        steps, F.lit(1.0), lambda acc, i: acc * (n - k + i).cast("double") / i.cast("double")
    )
    return F.when((k < 0) | (k > n), F.lit(0.0)).when(k == 0, F.lit(1.0)).otherwise(product)


def factorial_of(k: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
        F.lit(1.0),
        lambda acc, i: acc * i.cast("double"),
    )


def cell_text(c: Column) -> Column:
    """A cell as text from which its kind and value can be read back.

    Null is ``-``. Any other value is a letter of its kind (whole number, fraction, floating, boolean,
    date, time, text), the number of bytes of its text, ``:`` and the text. Fractions lose zeros at
    their end, so the scale of a column does not show. Cells are plain values; arrays and structs
    have to be made text first.
    """
    kind = F.typeof(c)
    letter = (
        F.when(kind.isin("tinyint", "smallint", "int", "bigint"), "i")
        .when(kind.startswith("decimal"), "d")
        .when(kind.isin("float", "double"), "f")
        .when(kind == "boolean", "b")
        .when(kind == "date", "D")
        .when(kind.startswith("timestamp"), "T")
        .otherwise("s")
    )
    text = c.cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    text = F.when(kind.startswith("decimal"), short).otherwise(text)
    return F.coalesce(F.concat(letter, F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*cols: Column) -> Column:
    """sha-256 of the columns' :func:`cell_text` in the given order: different rows have different texts."""
    return F.sha2(F.concat(*[cell_text(c) for c in cols]), 256)
