"""Uniform identifiers of documents and their sections: scheme://type_id_num_date_title[/type_sid_snum_eid_enum]*."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import percent_decode, percent_encode

SCHEME = "dsr"
RANK = {"annexe": 0, "titre": 1, "chapitre": 2, "article": 3, "unknown": 4, "alinea": 5}


def _part(tokens: list[Column]) -> Column:
    return F.array_join(F.array(*[F.coalesce(percent_encode(t), F.lit("")) for t in tokens]), "_")


def render(document: list[Column], sections: list[list[Column]] | None = None) -> Column:
    """The identifier; null if any token holds the separator ``_``. Null and empty tokens are empty."""
    parts = [document, *(sections or [])]
    bad = F.lit(False)
    for part in parts:
        for token in part:
            bad = bad | F.coalesce(F.contains(token, F.lit("_")), F.lit(False))
    path = F.concat(F.lit(f"{SCHEME}://"), _part(document), *[F.concat(F.lit("/"), _part(s)) for s in sections or []])
    return F.when(~bad, path)


def parse(uri: Column) -> Column:
    """Array of parts, each an array of five tokens (null where empty); null for another scheme or a wrong shape."""
    body = F.substring(uri, F.lit(len(SCHEME) + 4), F.length(uri))
    parts = F.transform(F.split(body, "/"), lambda p: F.transform(F.split(p, "_"), lambda t: F.nullif(percent_decode(t), F.lit(""))))
    shaped = F.forall(parts, lambda p: F.size(p) == 5)
    return F.when(F.startswith(uri, F.lit(f"{SCHEME}://")) & shaped, parts)


def valid_chain(types: Column, ends: Column) -> Column:
    """Whether section types go down in rank (unknown anywhere) and only the last section is a range."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    known = F.transform(F.filter(types, lambda t: t != "unknown"), lambda t: F.try_element_at(rank, t))
    ordered = F.array_sort(known) == known
    inner = F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))
    return ordered & ~F.exists(inner, lambda e: e.isNotNull())


def external_url(doc_type: Column, doc_id: Column, article_id: Column) -> Column:
    """Public address of a resolved document or article; European acts carry their address as id."""
    site = "https://www.legifrance.gouv.fr"
    return (
        F.when(doc_id.isNull(), None)
        .when(doc_type.isin("arrete-ministeriel", "decret", "circulaire"), F.concat(F.lit(f"{site}/jorf/id/"), doc_id))
        .when((doc_type == "code") & article_id.isNotNull(), F.concat(F.lit(f"{site}/codes/article_lc/"), article_id))
        .when(doc_type == "code", F.concat(F.lit(f"{site}/codes/texte_lc/"), doc_id))
        .when(doc_type.startswith("eu-"), doc_id)
    )


def valid_date(text: Column) -> Column:
    """Whether a document's date is missing or a day of the calendar as yyyy-mm-dd with a year of four figures."""
    return text.isNull() | (text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull())
