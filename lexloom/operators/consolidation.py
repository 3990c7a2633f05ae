"""Amendment operations linked to what they amend and to what they put in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import tree
from lexloom.operators.references import operations


def operations_with_references(lines: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Operations of the lines that hold a reference (semi-join before the grammar runs)."""
    return operations(lines.join(refs.select(*keys).distinct(), keys, "left_semi"), keys)


def targets(nodes: DataFrame, refs: DataFrame, doc: str) -> DataFrame:
    """(doc, operation, target): what each operation amends.

    The reference is the outermost one among the elements that end right before the operation; its targets are the
    leaves of its reference tree, the most specific references of the chain ("alinéa 3 de l'article 5"). ``nodes`` is the
    element tree with ``kind``; ``refs`` has doc, pre, root (``pre`` of the root of its chain) and leaf.
    """
    ops = nodes.where("kind = 'operation'")
    left = tree.contiguous_left(nodes.select(doc, "pre", "post", "parent", "depth", "kind"), doc, ops)
    reference = left.where("left_kind IN ('section', 'document')").groupBy(doc, "pre").agg(F.min_by("left_pre", "left_depth").alias("reference"))
    chain = refs.select(doc, F.col("pre").alias("reference"), "root")
    leaves = refs.where("leaf").select(doc, "root", F.col("pre").alias("target"))
    return reference.join(chain, [doc, "reference"]).join(leaves, [doc, "root"]).select(doc, F.col("pre").alias("operation"), "target")


def operands(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, operation, operand): the outermost block quote, inline quote or table that begins right after an operation
    with ``has_operand``, in the next paragraph too; null where there is none."""
    ops = nodes.where("kind = 'operation' AND has_operand")
    right = tree.contiguous_right(nodes.select(doc, "pre", "post", "parent", "depth", "kind"), doc, ops)
    first = right.where("next_kind IN ('blockquote', 'q', 'table')").groupBy(doc, "pre").agg(F.min("next_pre").alias("operand"))
    return ops.select(doc, "pre").join(first, [doc, "pre"], "left").select(doc, F.col("pre").alias("operation"), "operand")


def reference_leaves(refs: DataFrame, doc: str) -> DataFrame:
    """References (doc, pre, parent: ``pre`` of the reference they are part of) with the root of their chain and ``leaf``.

    Chains are short (alinéa, article, document), and go up by as many joins as they have levels.
    """
    up = refs.select(doc, F.col("pre").alias("root"), F.col("parent").alias("_up"))
    out = refs.withColumn("root", F.coalesce("parent", "pre"))
    for _ in range(4):
        out = out.join(up, [doc, "root"], "left").withColumn("root", F.coalesce("_up", "root")).drop("_up")
    above = refs.where("parent IS NOT NULL").select(doc, F.col("parent").alias("pre")).distinct().withColumn("_above", F.lit(True))
    return out.join(above, [doc, "pre"], "left").withColumn("leaf", F.col("_above").isNull()).drop("_above")
