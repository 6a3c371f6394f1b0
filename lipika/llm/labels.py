"""Label and address normal forms shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lipika.session import cut_lineage

#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown")
#: White space as Unicode has it, for Java patterns (Java's own \\s is ASCII only).
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def language_code(label: Column) -> Column:
    """Code before the first `-` or `_`, trimmed and lower-cased; null where the label names none."""
    code = strip(F.lower(F.regexp_extract(label, r"^([^-_]*)", 1)))
    return F.when(label.isNotNull() & ~code.isin(*NO_LANGUAGE), code)


def plain_label(label: Column, missing: str) -> Column:
    """Trimmed lower-case label; `missing` for null, empty and unknown."""
    value = strip(F.lower(label))
    return F.when(label.isNull() | value.isin("", "unknown"), missing).otherwise(value)


def site(url: Column) -> Column:
    """Host in lower case without port and leading `www.`; null where there is none."""
    host = F.regexp_extract(strip(F.lower(url)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def hash_sample(df: DataFrame, key: str, size: int, rows: int) -> DataFrame:
    """About `size` of the `rows` rows, by hash of the key, and never more than twice as many.

    No order is taken, so what reaches the driver does not grow with the number of partitions."""
    share = 1.0 if rows <= size else size / rows
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * size)


#: Most ids or keys that are broadcast; about 4 MB.
BROADCAST = 100_000


def checked(keys: DataFrame) -> DataFrame:
    """Keys, written to the shared folder; to be broadcast in joins if there are at most BROADCAST of them, else shuffled."""
    keys = cut_lineage(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys
