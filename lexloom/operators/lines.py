"""Lines of documents with their positions and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import grammar as G
from lexloom.functions.text import fold


def explode_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text", keep_newline: bool = False) -> DataFrame:
    """One row per line: doc, line_no from 0, contents, start_col 0 and end_col (the newline counts if kept).

    Null texts have no lines; an empty text has one empty line; with ``keep_newline`` a trailing empty piece is no line.
    """
    pieces = F.split(F.col(text), "\n", -1)
    rows = documents.select(F.col(doc), F.size(pieces).alias("_n"), F.posexplode(pieces).alias("line_no", "contents"))
    if keep_newline:
        last = F.col("line_no") == F.col("_n") - 1
        rows = rows.where(~(last & (F.col("contents") == ""))).withColumn("contents", F.when(last, F.col("contents")).otherwise(F.concat("contents", F.lit("\n"))))
    return rows.select(doc, "line_no", "contents", F.lit(0).alias("start_col"), F.length("contents").alias("end_col"))


def combine(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments combined per key: least start, greatest end."""
    return segments.groupBy(*keys).agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))


def is_table(raw: Column) -> Column:
    return F.contains(raw, F.lit("|"))


def is_image(raw: Column) -> Column:
    return raw.rlike(G.IMAGE)


def is_footer(folded: Column) -> Column:
    return folded.rlike(G.FOOTER)


def is_contents(folded: Column) -> Column:
    return folded.rlike(G.CONTENTS)


def is_document_element(raw: Column, folded: Column) -> Column:
    """Page footers and tables of contents; the image test comes first, as image lines can be very long."""
    return F.when(is_image(raw), False).otherwise(is_footer(folded) | is_contents(folded))


def header_role(folded: Column) -> Column:
    """The header element a line begins, the first in order of precedence; null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(G.HEADERS.items()):
        hit = folded.rlike(pattern)
        if name == "arrete_title":
            hit = hit & ~folded.rlike(G.PAGING)
        out = F.when(hit, name).otherwise(out)
    return out


def is_title(folded: Column) -> Column:
    """Section names with or without numbering, dotted numbers, or one number and a text that does not end a clause."""
    paged = folded.rlike(G.PAGING)
    return (
        folded.rlike(G.TITLE_BARE)
        | (folded.rlike(G.TITLE_NAMED) & ~paged)
        | (folded.rlike(G.TITLE_DOTTED) & ~paged)
        | (folded.rlike(G.TITLE_PLAIN) & ~paged & ~folded.rlike(G.TITLE_ENDING))
    )


def block_role(raw: Column, folded: Column) -> Column:
    """The kind of block a line belongs to: table, list, blockquote, image or paragraph."""
    return F.when(is_table(raw), "table").when(folded.rlike(G.LIST), "list").when(folded.rlike(G.QUOTE_START), "blockquote").when(is_image(raw), "image").otherwise("paragraph")


def title_parts(folded: Column) -> list[Column]:
    """section_type, number and text of a title line; the first form that matches decides."""
    bare, named, dotted = folded.rlike(G.TITLE_BARE), folded.rlike(G.TITLE_NAMED), folded.rlike(G.TITLE_DOTTED)
    kind = F.when(bare, F.regexp_extract(folded, G.TITLE_BARE, 1)).when(named, F.regexp_extract(folded, G.TITLE_NAMED, 1)).otherwise("unknown")
    ordinal = F.regexp_extract(folded, G.TITLE_NAMED, 2)
    figured = F.concat(F.regexp_extract(folded, G.TITLE_NAMED, 3), F.regexp_extract(folded, G.TITLE_NAMED, 4))
    number = F.when(bare, "").when(named, F.when(ordinal != "", ordinal).otherwise(figured)).when(dotted, F.regexp_extract(folded, G.TITLE_DOTTED, 1)).otherwise(F.regexp_extract(folded, G.TITLE_PLAIN, 1))
    text = F.when(bare, "").when(named, F.regexp_extract(folded, G.TITLE_NAMED, 5)).when(dotted, F.regexp_extract(folded, G.TITLE_DOTTED, 2)).otherwise(F.regexp_extract(folded, G.TITLE_PLAIN, 2))
    return [kind.alias("section_type"), F.regexp_replace(number, r"\.$", "").alias("number"), text.alias("title_text")]


def featured(lines: DataFrame, text: str = "contents") -> DataFrame:
    """Lines with their folded text and all features the segmentation needs."""
    folded = lines.withColumn("folded", fold(F.col(text)))
    raw, f = F.col(text), F.col("folded")
    return folded.select("*", block_role(raw, f).alias("block"), header_role(f).alias("header"), is_title(f).alias("title"), is_document_element(raw, f).alias("document_element"))
