"""Text functions of the cleaning step as Column expressions; Python only where the JVM has no such function."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import grammar as G


def fold(text: Column) -> Column:
    """Lower case, no accents, plain quotes and dashes; keeps every offset."""
    return F.translate(F.lower(text), G.FOLD_FROM, G.FOLD_TO)


def strip_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"[\n\r]+$", "")


def strip_headings(text: Column) -> Column:
    """Leading # and spaces go, except before list items."""
    return F.when(fold(text).rlike(G.LIST), text).otherwise(F.regexp_replace(text, r"^\s*[#\s]+", ""))


def strip_emphasis(text: Column) -> Column:
    """Opening asterisks at the start of a line, any number, go together with the next run of as many; unpaired ones stay."""
    opening = r"^((?:>|→|-|[a-zA-Z1-9][)°])?\s*)(\*+)(?=[^*\s])"
    bullet, stars = F.regexp_extract(text, opening, 1), F.regexp_extract(text, opening, 2)
    rest = F.substring(text, F.length(bullet) + F.length(stars) + 1, F.length(text))
    at = F.instr(rest, stars)
    closed = F.concat(bullet, F.left(rest, at - 1), F.substring(rest, at + F.length(stars), F.length(rest)))
    return F.when(F.contains(text, F.lit("*")), F.when((stars != "") & (at > 1), closed).otherwise(text)).otherwise(text)


# Glyphs that scanning makes of others, in order.
GLYPHS = (("n̊", "n°"), ("N̊", "N°"), ("Nํ", "N°"), ("ı", "i"), ("p̧i", "pti"), ("p̣", "p"), ("Y̌", "Y"), ("g̣", "g"), ("'́p", "p"), ("º", "°"))


def repair_glyphs(text: Column) -> Column:
    out = text
    for wrong, right in GLYPHS:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.when(text.rlike("[^ -~\u00a0-\u00b9\u00bb-\u00ff]"), out).otherwise(text)


def repair_months(text: Column) -> Column:
    """A month's short form followed by a comma was read for one with a point."""
    out, stems = text, []
    for point in (m for m in G.MONTH_POINTS if m.endswith(".")):
        accented = {"fevr.": "févr.", "dec.": "déc."}.get(point, point)
        stems.append(accented[:-1].replace("é", "[ée]"))
        out = F.regexp_replace(out, rf"(?iu)\s{stems[-1]},\s", f" {accented} ")
    return F.when(text.rlike(rf"(?iu)\s(?:{'|'.join(stems)}),\s"), out).otherwise(text)


def unescape(text: Column) -> Column:
    """Escaped signs, line breaks outside tables and the footnote mark of the reader go."""
    text = F.replace(F.replace(text, F.lit("\\%"), F.lit("%")), F.lit("\\&"), F.lit("&"))
    text = F.when(F.contains(text, F.lit("|")), text).otherwise(F.replace(text, F.lit("<br>"), F.lit("")))
    return F.regexp_replace(text, r"\[\^0\]\s*", "")


def recompose(text: Column) -> Column:
    """Letter-spaced words of the dictionary (vu, arrete, arretent) closed up; other spaced letters stay."""
    spread = text.rlike(r"(?iu)(?<!\p{L})[av]\s[ru]")
    out = text
    for word in ("arretent", "arrete", "vu"):
        spaced = r"\s".join(f"[{c}éêèÉÊÈ]" if c == "e" else c for c in word)
        out = F.regexp_replace(out, rf"(?iu)(?<!\p{{L}})(?<!(?<!\p{{L}})\p{{L}}\s)({spaced})(?!\s?[\p{{L}}](?:\s|$)|[\p{{L}}])", "\u0002$1\u0003")
    parts = F.split(out, "\u0002", -1)
    closed = F.transform(parts, lambda p: F.when(F.contains(p, F.lit("\u0003")), F.concat(F.regexp_replace(F.substring_index(p, "\u0003", 1), r"\s", ""), F.substring_index(p, "\u0003", -1))).otherwise(p))
    return F.when(spread, F.array_join(closed, "")).otherwise(text)


def useful(text: Column) -> Column:
    """False for blank and punctuation-only lines."""
    return ~text.rlike(G.PUNCTUATION_ONLY)


def percent_encode(token: Column) -> Column:
    """Percent-encoding that leaves only letters, digits and _.-~ as they are."""
    out = F.url_encode(token)
    for found, right in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(right))
    return out


def percent_decode(token: Column) -> Column:
    return F.try_url_decode(F.replace(token, F.lit("+"), F.lit("%2B")))


# Sub- and superscript digits.
_SUB, _SUP = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹"
_NAMES = {"circ": "°", "times": "x", "leq": "≤", "geq": "≥", "cdot": "·", "pm": "±", "mu": "μ", "alpha": "α", "beta": "β"}


def _latex(text: str) -> str:
    def formula(m):
        s = regex.sub(r"\\\\+", r"\\", m.group(1))
        s = regex.sub(r"\\(?:mathrm|mathbf|text|textbf|mathit|operatorname)\s*\{([^{}]*)\}", r"\1", s)
        s = regex.sub(r"\\([%&#_$,; ])", lambda k: k[1] if k[1] in "%&#_$" else " ", s)
        s = regex.sub(r"\\([A-Za-z]+)", lambda k: _NAMES.get(k[1], ""), s)
        s = s.replace("{", "").replace("}", "").replace("\u00a0", "")
        s = regex.sub(r"\^(?!\d)", "", s)
        s = regex.sub(r"_(\d+)", lambda k: "".join(_SUB[int(c)] for c in k[1]), s)
        s = regex.sub(r"\^(\d+)", lambda k: "".join(_SUP[int(c)] for c in k[1]), s)
        return unicodedata.normalize("NFKD", s) if any("\U0001d400" <= c <= "\U0001d7ff" for c in s) else s.replace("∘", "°").replace("×", "x")

    return regex.sub(r"\$(.*?)\$", formula, text)


def _diacritics(text: str) -> str:
    out: list[str] = []
    for c in unicodedata.normalize("NFD", text):
        if unicodedata.combining(c) and out and unicodedata.combining(out[-1]) and len(out) > 1 and out[-2].isascii():
            continue
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def _python_part(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _diacritics(_latex(t)), na_action="ignore")


def plain_formulas(text: Column) -> Column:
    """Inline LaTeX to text and double accents to single ones; lines with neither never leave the JVM in effect."""
    needs = text.contains("$") | text.rlike(r"\p{M}")
    return F.when(needs, F.pandas_udf(_python_part, T.StringType())(F.when(needs, text))).otherwise(text)


CLEANING = (strip_newlines, strip_emphasis, strip_headings, plain_formulas, repair_months, repair_glyphs, unescape, recompose)


def clean(lines: DataFrame, text: str) -> DataFrame:
    """The cleaning step on a text column, in its order. One projection a step: a step that looks at its text several
    times then looks at a computed value, where one nested expression would compute every earlier step again. The last
    one generates its column, so that filters on the cleaned text stay above it instead of being put into the first."""
    for step in CLEANING:
        lines = lines.withColumn(text, step(F.col(text)))
    return lines.select(*[F.explode(F.array(F.col(c))).alias(c) if c == text else F.col(f"`{c}`") for c in lines.columns])
