"""Column expressions on names, ids, dates, bands and JSON."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(name: Column) -> Column:
    """Lower case, without marks of Latin letters, hyphens and repeated blanks."""
    marks, plain = "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"
    return F.trim(F.regexp_replace(F.translate(F.lower(name), marks + "-", plain + " "), r"\s+", " "))


def name_forms(name: Column) -> Column:
    """The spellings under which one full name is met: full, `surname i.` and `surname, first`."""
    base = folded(name)
    first, last = F.substring_index(base, " ", 1), F.substring_index(base, " ", -1)
    return F.array_distinct(F.array(base, F.concat(last, F.lit(" "), F.substring(first, 1, 1), F.lit(".")), F.concat(last, F.lit(", "), first)))


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (a, b) and (b, a)."""
    return F.concat_ws("|", F.array_sort(F.array(a, b)))


def hash_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def sample_unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) that the key and the salt fix: the first 12 hex digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), key.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(16**12)


def band(x: Column, edges: Sequence[float]) -> Column:
    """Number of the band [edge, next edge) that holds x; null below the first edge."""
    out = F.lit(None).cast("int")
    for k, edge in enumerate(edges):
        out = F.when(x >= edge, k).otherwise(out)
    return out


def season(day: Column) -> Column:
    """`2023/24` for days from July 2023 to June 2024."""
    first = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    return F.concat(first.cast("string"), F.lit("/"), F.lpad(F.pmod(first + 1, F.lit(100)).cast("string"), 2, "0"))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def stale(ts: Column, now: Column, seconds: int) -> Column:
    return ts.isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")) > seconds * 1_000_000)


def number(text: Column, kind: str = "double") -> Column:
    """A number that isn't negative, else null."""
    got = text.try_cast(kind)
    return F.when(got >= 0, got)


def exchange_spread(text: Column) -> Column:
    """1/back - 1/lay from `back@lay`; null where the text says otherwise."""
    back, lay = (F.regexp_extract(text, r"^(\d+(?:\.\d+)?)@(\d+(?:\.\d+)?)$", k).try_cast("double") for k in (1, 2))
    return F.when((back > 1) & (lay > 1), 1 / back - 1 / lay)


def sorted_json(entries: Column) -> Column:
    """JSON of an array of (key, value) structs, keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def market_family(name: Column) -> Column:
    return F.when(name.rlike("(?i)(match.?odds|1x2|moneyline)"), "RESULT").when(name.rlike("(?i)(over|under|total)"), "TOTALS").when(name.rlike("(?i)handicap"), "HANDICAP").otherwise("OTHER")


def book_width(text: Column) -> Column:
    """The largest 1/back - 1/lay of the runners in a text of `back/lay` prices; null without any. A price of 0 has an infinite
    chance, and two of them no width (NaN, which is the largest)."""
    price = r"(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)"
    inverse = lambda x: F.when(x == 0, math.inf).otherwise(1 / F.nullif(x, F.lit(0.0)))
    of = lambda k: F.transform(F.regexp_extract_all(text, F.lit(price), F.lit(k)), lambda x: inverse(x.try_cast("double")))
    return F.array_max(F.zip_with(of(1), of(2), lambda back, lay: back - lay))


def nullable_int(text: Column) -> Column:
    """A whole number that isn't negative; blank, invalid or negative text is null."""
    return number(F.trim(text), "int")
