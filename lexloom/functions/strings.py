"""Small text functions: normalisation by flags, merging of texts, attribute codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import grammar as G

_FOLDS = dict(zip(G.FOLD_FROM, G.FOLD_TO, strict=True))


def normalize(text: Column, case: bool = True, accents: bool = True, quotes: bool = True, dashes: bool = True) -> Column:
    """Normalised text, one to one so that offsets hold; each flag switches one kind of folding on."""
    def kind(c: str) -> bool:
        return quotes if _FOLDS[c] in "'\"" else dashes if _FOLDS[c] == "-" else accents

    pairs = {c: r for c, r in _FOLDS.items() if kind(c)}
    if accents and not case:
        pairs |= {c.upper(): r.upper() for c, r in pairs.items() if c.isalpha() and len(c.upper()) == 1}
    return F.translate(F.lower(text) if case else text, "".join(pairs), "".join(pairs.values()))


def first_choice(values: DataFrame, value: str, choices: DataFrame, choice: str, rank: str, out: str) -> DataFrame:
    """The first choice (by ``rank``) equal to a value under normalisation, in ``out``; null where none is."""
    first = choices.groupBy(normalize(F.col(choice)).alias("_n")).agg(F.min_by(choice, rank).alias(out))
    return values.withColumn("_n", normalize(F.col(value))).join(first, "_n", "left").drop("_n")


def without_span(text: Column, start: Column, length: Column) -> Column:
    """A text without ``length`` characters from ``start`` (from 0) on."""
    return F.concat(F.left(text, start), F.substring(text, start + length + 1, F.length(text)))


def merge_texts(flow: DataFrame, key: str, at: str) -> DataFrame:
    """A flow of rows (``kind`` text or element, ``text``) with neighbouring texts joined and empty ones gone; elements stay apart."""
    w = Window.partitionBy(key).orderBy(at)
    rows = flow.where("kind <> 'text' OR length(text) > 0")
    new = F.when((F.col("kind") == "text") & (F.lag("kind").over(w) == "text"), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "text"))), lambda x: x["text"]), "")
    return rows.groupBy(key, "piece").agg(F.first("kind").alias("kind"), joined.alias("text"))


def bool_attribute(value: Column) -> Column:
    return F.when(value, "true").otherwise("false")


def parse_bool(text: Column) -> Column:
    """true and false; null for any other text."""
    return F.when(text == "true", True).when(text == "false", False)


def list_attribute(values: Column) -> Column:
    """Values joined by commas; null for none."""
    return F.when(F.size(values) > 0, F.array_join(values, ","))


def parse_list(text: Column) -> Column:
    """The values of a list attribute; an empty or missing one has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def has_class(classes: Column, *wanted: str) -> Column:
    """Whether an element has any of the classes; a class with a space in it is an error."""
    if any(" " in c for c in wanted):
        raise ValueError("a class has no spaces")
    return F.arrays_overlap(classes, F.array(*[F.lit(c) for c in wanted]))
