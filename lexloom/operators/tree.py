"""Navigation of document trees in interval encoding: pre is a node's place, post the place of its last descendant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def descendants(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, ancestor, descendant) pairs by interval containment within a document."""
    a, d = nodes.alias("a"), nodes.alias("d")
    inside = (F.col(f"a.{doc}") == F.col(f"d.{doc}")) & (F.col("d.pre") > F.col("a.pre")) & (F.col("d.pre") <= F.col("a.post"))
    return a.join(d, inside).select(F.col(f"a.{doc}").alias(doc), F.col("a.pre").alias("ancestor"), F.col("d.pre").alias("descendant"))


def common_ancestor(nodes: DataFrame, pairs: DataFrame, doc: str) -> DataFrame:
    """Closest common ancestor (or self) of node pairs (doc, left, right)."""
    n = nodes.select(F.col(doc), "pre", "post")
    hit = (F.col("p." + doc) == F.col("n." + doc)) & F.col("n.pre").between(0, F.least("p.left", "p.right")) & (F.col("n.post") >= F.greatest("p.left", "p.right"))
    return pairs.alias("p").join(n.alias("n"), hit).groupBy(F.col(f"p.{doc}").alias(doc), F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.max("n.pre").alias("ancestor"))


def contiguous_right(nodes: DataFrame, doc: str, starts: DataFrame | None = None) -> DataFrame:
    """For each start the nodes that begin right after its subtree, outer to inner: (doc, pre, next_pre, next_depth, next_kind).

    The first is the node after the subtree, wherever it is; the others are its chain of first children, whose depth
    grows as fast as their place. ``starts`` are nodes; all by default. ``kind`` is optional.
    """
    kind = F.col("kind") if "kind" in nodes.columns else F.lit(None).cast("string")
    after = (nodes if starts is None else starts).select(F.col(doc), "pre", (F.col("post") + 1).alias("_at"))
    rows = nodes.select(F.col(doc).alias("_d"), F.col("pre").alias("next_pre"), F.col("post").alias("_post"), F.col("depth").alias("next_depth"), kind.alias("next_kind"))
    first = after.join(rows, (F.col(doc) == F.col("_d")) & (F.col("next_pre") == F.col("_at"))).select(doc, "pre", "_at", F.col("_post").alias("_end"), (F.col("next_depth") - F.col("next_pre")).alias("_slope"))
    chain = rows.withColumn("_slope", F.col("next_depth") - F.col("next_pre")).withColumnRenamed("_d", doc)
    return first.join(chain, [doc, "_slope"]).where(F.col("next_pre").between(F.col("_at"), F.col("_end"))).select(doc, "pre", "next_pre", "next_depth", "next_kind")


def contiguous_left(nodes: DataFrame, doc: str, starts: DataFrame | None = None) -> DataFrame:
    """For each start the nodes whose subtree ends right before it: (doc, pre, left_pre, left_depth, left_kind).

    A start that is a first child begins where the highest ancestor begins that it is the first thing of, so its left
    neighbour is that ancestor's.
    """
    kind = F.col("kind") if "kind" in nodes.columns else F.lit(None).cast("string")
    own = (nodes if starts is None else starts).select(doc, "pre", (F.col("depth") - F.col("pre")).alias("_slope"), F.col("pre").alias("_begin"))
    ups = nodes.select(F.col(doc), F.col("pre").alias("_up"), F.col("post").alias("_up_post"), (F.col("depth") - F.col("pre")).alias("_slope"))
    # ancestors of which a node is the first thing lie on one slope with it
    climbed = own.join(ups, [doc, "_slope"]).where((F.col("_up") <= F.col("pre")) & (F.col("_up_post") >= F.col("pre"))).groupBy(doc, "pre").agg(F.min("_up").alias("_begin"))
    ends = nodes.select(F.col(doc).alias("_d"), F.col("pre").alias("left_pre"), F.col("post").alias("left_post"), F.col("depth").alias("left_depth"), kind.alias("left_kind"))
    return climbed.join(ends, (F.col(doc) == F.col("_d")) & (F.col("left_post") == F.col("_begin") - 1)).select(doc, "pre", "left_pre", "left_depth", "left_kind")


def element_ids(nodes: DataFrame, referenced: DataFrame, doc: str) -> DataFrame:
    """(doc, pre, element_id): numbers from 1 in document order for the nodes that are referred to, each once."""
    own = nodes.join(referenced.select(doc, "pre").distinct(), [doc, "pre"], "left_semi")
    return own.select(doc, "pre", F.row_number().over(Window.partitionBy(doc).orderBy("pre")).alias("element_id"))


def data_element(schema: Column, contents: Column, data: dict[str, Column]) -> Column:
    """A data element as a struct: its class, contents and attributes; attributes without a value are left out."""
    pairs = F.array(*[F.struct(F.lit(f"data-{k}").alias("key"), v.cast("string").alias("value")) for k, v in data.items()])
    return F.struct(F.concat(F.lit("dsr-"), schema).alias("css_class"), contents.alias("contents"), F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("data"))


def replace_children(nodes: DataFrame, doc: str, parent: DataFrame, children: DataFrame) -> DataFrame:
    """``nodes`` where the subtrees below the nodes of ``parent`` (doc, pre) are replaced by ``children``."""
    over = nodes.join(parent.select(doc, "pre"), [doc, "pre"], "left_semi").select(F.col(doc).alias("_d"), F.col("pre").alias("_a"), F.col("post").alias("_b"))
    below = nodes.join(over, (F.col(doc) == F.col("_d")) & (F.col("pre") > F.col("_a")) & (F.col("pre") <= F.col("_b")), "left_anti")
    return below.unionByName(children)


def growing_ranges(nodes: DataFrame, doc: str, start: DataFrame, reach: int, right: bool = True) -> DataFrame:
    """(doc, pre, first, last, node): the collapsed ranges that begin at a start and grow by one leaf at a time to the
    right or left, for as many leaves as ``reach``."""
    leaves = nodes.where("pre = post").select(F.col(doc), F.col("pre").alias("_leaf"))
    begin, step = ("post", F.col("_leaf") > F.col("_from")) if right else ("pre", F.col("_leaf") < F.col("_from"))
    froms = start.select(F.col(doc), "pre", F.col("pre").alias("_s"), F.col("post").alias("_e"), F.col(begin).alias("_from"))
    near = Window.partitionBy(doc, "pre").orderBy(F.col("_leaf").asc() if right else F.col("_leaf").desc())
    ranged = froms.join(leaves, doc).where(step).withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= reach)
    first = F.col("_s") if right else F.col("_leaf")
    last = F.col("_leaf") if right else F.col("_e")
    chosen = ranged.select(doc, F.col("pre").alias("start"), first.alias("first"), last.alias("last"))
    return collapse(nodes, chosen.drop("start").distinct(), doc).withColumnRenamed("pre", "node").join(chosen, [doc, "first", "last"]).select(doc, F.col("start").alias("pre"), "first", "last", "node")


def collapse(nodes: DataFrame, chosen: DataFrame, doc: str) -> DataFrame:
    """A range (doc, first, last) of nodes as the fewest whole subtrees: inside the range, but not their parent.

    An element of which nothing below is in the range, as when the range ends at its opening, counts as a leaf.
    """
    near = (F.col(f"n.{doc}") == F.col(f"c.{doc}")) & (F.col("n.pre") >= F.col("c.first")) & (F.col("n.pre") <= F.col("c.last"))
    touched = nodes.alias("n").join(chosen.alias("c"), near & ((F.col("n.post") <= F.col("c.last")) | (F.col("n.pre") == F.col("c.last")))).select(F.col(f"n.{doc}").alias(doc), "n.pre", "n.parent", "c.first", "c.last")
    up = touched.select(doc, F.col("pre").alias("parent"), "first", "last")
    return touched.join(up, [doc, "parent", "first", "last"], "left_anti").select(doc, "first", "last", "pre")
