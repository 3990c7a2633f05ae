"""Reference chains: the document at the root of a chain completes the identifiers of the sections below it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.hierarchy import hierarchy


def with_root_document(refs: DataFrame, doc: str, node: str, parent: str, order: str) -> DataFrame:
    """Every reference with the path and the root of its chain, and the root's uri: the document its sections belong to.

    References on a loop have no root and keep null; see ``hierarchy`` for the other defined cases.
    """
    placed = hierarchy(refs, doc, node, parent, order)
    uris = refs.groupBy(F.col(doc), F.regexp_replace(F.regexp_extract(node, r"(\d+)", 1), r"^0+(?=\d)", "").alias("root")).agg(F.max("uri").alias("root_uri"))
    return placed.join(uris, [doc, "root"], "left")
