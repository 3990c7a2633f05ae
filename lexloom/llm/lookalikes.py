"""Text that looks the same but is stored in other characters, brought to one plain form.

Values with unusual characters are look-alike-mapped, grouped in SQL under the accent-sensitive collation UNICODE
(canonically equivalent and invisible-character variants fall together), one deterministic canonical member is
chosen per class, and it is joined back to every row that holds a member.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.runtime import cut

# The characters of plain French besides ASCII.
FRENCH_LETTERS = "ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŸŒÆàâäçèéêëîïôöùûüÿœæ"
TYPED_SIGNS = "’‘«»–—“”¬°²³µ€×½§"
PLAIN = " -~\t\n\r" + FRENCH_LETTERS + TYPED_SIGNS
SUSPECT = "[^" + PLAIN + "]"

# Letters of other alphabets that look like a Latin letter.
LOOKALIKE = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D", "Ӏ": "I", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "ү": "y", "х": "x", "ԝ": "w", "ѵ": "v", "г": "r", "ё": "ë", "ї": "ï", "к": "k", "м": "m",
    "т": "t", "в": "b", "н": "h", "п": "n", "ь": "b",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "α": "a", "τ": "t",
    "γ": "y", "χ": "x", "σ": "o", "η": "n", "ω": "w", "β": "ß", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "μ": "µ",
    "Տ": "S", "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Լ": "L",
}
# Those of them whose shape is the Latin letter's own, so that even a whole token of them imitates.
TWINS = "АВСЕНІЈКМОРЅТХԚԜӀасԁеһіјӏорԛѕухԝѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳϹͿՏՕօ"
# Single characters read as a plain sign or letter that compatibility folding would miss.
SIGNS = {
    "‐": "-", "‑": "-", "−": "-", "˗": "-", "֊": "-", "․": ".", "‚": ",",
    "ʼ": "'", "ʹ": "'", "′": "'", "´": "'", "ˊ": "'", "ꞌ": "'", "⁄": "/",
    "∕": "/", "∶": ":", "꞉": ":", "ː": ":", "ǃ": "!", "∣": "|", "ǀ": "|",
    "∗": "*", "∼": "~", "˜": "~", "º": "°", "˚": "°", "∘": "°", "ı": "i",
    "ɑ": "a", "ɡ": "g", "ɪ": "I", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v",
    "ᴡ": "w", "ᴢ": "z", "‹": "<", "›": ">", "《": "«", "》": "»", "⸗": "-",
}

_TOKEN = regex.compile(r"(?:[^\W\d_]|[̀-ͯ])+")
_OTHER = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}]")
_LATIN = regex.compile(r"\p{Latin}")


@lru_cache(maxsize=1 << 16)
def _character(ch: str) -> str:
    """One character without its context: folded if it is a disguise, dropped if invisible, else itself."""
    if ch in SIGNS:
        return SIGNS[ch]
    kind = unicodedata.category(ch)
    if ch in TYPED_SIGNS or ch in "\t\n\r":
        return ch
    if kind in ("Cf", "Cc", "Co") or ch in "͏ᅟᅠㅤﾠ឴឵" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind in ("Zs", "Zl", "Zp"):
        return " "
    folded = unicodedata.normalize("NFKC", ch)
    if folded == ch:
        return ch
    if folded.startswith(" ") and len(folded) == 2:  # a spacing accent: no plain sign to imitate
        return ch
    return "".join(SIGNS.get(c, c) for c in folded)


def _token(match) -> str:
    """Letters of another alphabet inside a Latin word, or a token made only of exact twins, become Latin."""
    word = match.group()
    if not _OTHER.search(word):
        return word
    letters = [c for c in word if not "̀" <= c <= "ͯ"]
    if not _LATIN.search(word):
        if not all(c in TWINS for c in letters):
            return word
    return "".join(LOOKALIKE.get(c, c) for c in word)


def map_lookalikes(text: str) -> str:
    """Look-alike mapping alone: other characters for the same picture; accents stay as they are stored."""
    return _TOKEN.sub(_token, "".join(map(_character, text)))


def plain_form(text: str) -> str:
    """The plain form: look-alikes mapped, composed, invisible characters gone."""
    return unicodedata.normalize("NFC", map_lookalikes(text))


def suspect(col: Column) -> Column:
    """Whether a value holds any character outside the plain repertoire; such values alone need Python."""
    return F.coalesce(col.rlike(SUSPECT), F.lit(False))


@F.pandas_udf(T.StringType())
def _mapped(values: pd.Series) -> pd.Series:
    return values.map(map_lookalikes, na_action="ignore")


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def canonical_values(values: DataFrame, col: str) -> DataFrame:
    """(value, canonical) for each distinct suspect value of ``col``.

    One class is one group under collation UNICODE of the mapped values; the canonical member is the one with the
    fewest characters outside the plain repertoire, then the shortest, then the least in binary order.
    """
    spark = values.sparkSession
    distinct = values.select(F.col(f"`{col}`").alias("value")).where(suspect(F.col("value"))).distinct()
    members = (
        distinct.withColumn("mapped", _mapped("value"))
        .withColumn("composed", _composed("mapped"))
        .withColumn("flaws", F.length("composed") - F.length(F.regexp_replace("composed", SUSPECT, "")))
    )
    members = cut(members)
    return spark.sql(
        """
        SELECT m.value, c.canonical
        FROM {members} m JOIN (
            SELECT mapped COLLATE UNICODE AS class, min_by(composed, struct(flaws, length(composed), composed)) AS canonical
            FROM {members}
            GROUP BY mapped COLLATE UNICODE
        ) c ON m.mapped COLLATE UNICODE = c.class
        """,
        members=members,
    )


def unify(df: DataFrame, col: str, out: str = "plain") -> DataFrame:
    """``df`` with the plain form of text column ``col`` in ``out`` (replaced if it exists).

    Defined cases: null stays null; empty text and text in plain characters come back unchanged; whole texts of any
    length are processed; ties within a class fall to the least member; repeated rows are kept; an empty table gives
    an empty table; other columns pass through whatever their names.
    """
    forms = canonical_values(df, col).withColumnRenamed("value", "_lookalike_value").withColumnRenamed("canonical", "_lookalike_canonical")
    value = F.col(f"`{col}`")
    # plain rows do not take part in the join, so they stay spread as they are
    found = df.where(suspect(value)).join(forms, value == F.col("_lookalike_value")).withColumn(out, F.col("_lookalike_canonical"))
    return found.drop("_lookalike_value", "_lookalike_canonical").unionByName(df.where(~suspect(value)).withColumn(out, value))


def disguised(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Keys of the rows whose text is not in plain form, each once. Only suspect rows reach the join; they are written
    once, as every row is tested by a pattern that costs more than reading them again."""
    rows = cut(df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{col}`").alias("_text")).where(suspect(F.col("_text"))))
    return unify(rows, "_text", "_plain").where("_text <> _plain").select(*[f"`{k}`" for k in keys]).distinct()
