"""Numbers of sections: ordinals, levels and whether a number follows another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import grammar as G


def ordinal_to_int(word: Column) -> Column:
    """premier ... treizieme to 1 ... 13, accents optional; null otherwise."""
    pairs = [F.lit(x) for kv in G.ORDINALS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), word)


def level_of(part: Column, parity: bool = True) -> Column:
    """One part of a number: roman below 40, else a letter's place, else figures; a lone V is a letter under parity."""
    romans = {k: n for k, n in G.ROMANS.items() if not (parity and k == "V")}
    roman = F.try_element_at(F.create_map(*[F.lit(x) for kv in romans.items() for x in kv]), F.upper(part))
    letter = F.when(part.rlike("^[a-zA-Z]$"), F.ascii(F.upper(part)) - 64)
    figures = F.when(part.rlike(r"^\d{1,2}$"), part.cast("int"))
    return F.coalesce(roman, letter, figures)


def levels(number: Column, parity: bool = True) -> Column:
    """Levels of a number split at points, hyphens and spaces; null for an empty or unreadable number."""
    parts = F.filter(F.split(number, r"[.\- ]+"), lambda p: p != "")
    out = F.transform(parts, lambda p: level_of(p, parity))
    return F.when((F.size(parts) > 0) & ~F.exists(out, lambda x: x.isNull()), out)


def contiguous(current: Column, new: Column) -> Column:
    """Whether ``new`` may follow ``current``: deeper ends in 1, same or higher level counts one on, the common part is the same."""
    n, c = F.size(new), F.size(current)
    last = F.element_at(new, -1)
    prefix = F.slice(new, 1, F.greatest(n - 1, F.lit(0))) == F.slice(current, 1, F.greatest(n - 1, F.lit(0)))
    return (
        F.when(new.isNull() | (n == 0), False)
        .when(current.isNull(), True)
        .when(n > c, (last == 1) & (F.slice(new, 1, c) == current))
        .otherwise(prefix & (last == F.try_element_at(current, n) + 1))
    )
