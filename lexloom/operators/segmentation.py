"""Segmentation of ordered lines by windows: runs, header labels, parts, nested sections, numbered alineas, quotes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import grammar as G
from lexloom.functions.numbering import contiguous, levels, ordinal_to_int
from lexloom.operators.lines import title_parts

RANKS = {"annexe": 0, "titre": 1, "chapitre": 2, "article": 3, "unknown": 4}


def _order(doc: str, at: str):
    return Window.partitionBy(doc).orderBy(at)


def runs(lines: DataFrame, doc: str, at: str, label: str) -> DataFrame:
    """Runs of consecutive lines with one label: doc, label, run (from 1), first_line, last_line, n_lines."""
    w = _order(doc, at)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = lines.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "run").agg(F.first(label).alias(label), F.min(at).alias("first_line"), F.max(at).alias("last_line"), F.count("*").alias("n_lines"))


def parts(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """``part`` of each line: header before the first title, then main, then appendix from the first annexe title on."""
    whole = Window.partitionBy(doc)
    title_at = F.min(F.when(F.col("title"), F.col(at))).over(whole)
    annexe_at = F.min(F.when(F.col("title") & F.col("folded").startswith("annexe"), F.col(at))).over(whole)
    return lines.withColumn("part", F.when(F.col(at) >= annexe_at, "appendix").when(F.col(at) >= title_at, "main").otherwise("header"))


def header_labels(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Header lines with the element they belong to: a line that begins none continues the one before."""
    w = _order(doc, at).rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.when(F.col("document_element"), F.lit("document_element")), F.col("header"))
    return parts(lines, doc, at).where("part = 'header'").withColumn("_own", own).withColumn("element", F.coalesce(F.last("_own", ignorenulls=True).over(w), F.lit("beginning"))).drop("_own")


def titles(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Title lines with type, number, levels, contiguity, nesting depth and parent section.

    The depth of a section is the least of its own level and one more than the depth before it. Unrolled, that is a
    running minimum, so no stack and no Python is needed; the parent is the last section one level up.
    """
    rows = lines.where("title").select(doc, at, "folded", *title_parts(F.col("folded")))
    shown = F.when(ordinal_to_int(F.col("number")).isNotNull(), ordinal_to_int(F.col("number")).cast("string")).otherwise(F.col("number"))
    rows = rows.withColumn("number", shown).withColumn("levels", levels(F.col("number")))
    w = _order(doc, at)
    same = Window.partitionBy(doc, "section_type").orderBy(at)
    rows = rows.withColumn("contiguous", contiguous(F.lag("levels").over(w), F.col("levels")) | contiguous(F.lag("levels").over(same), F.col("levels")))
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    rows = rows.withColumn("rank", rank[F.col("section_type")]).withColumn("n_levels", F.coalesce(F.size("levels"), F.lit(0))).withColumn("n_levels", F.greatest("n_levels", F.lit(0)))
    above: Column = F.lit(0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for r in RANKS.values():
        upstream = F.max(F.when(F.col("rank") < r, F.col("n_levels"))).over(before)
        above = F.when(F.col("rank") == r, F.coalesce(upstream, F.lit(0))).otherwise(above)
    rows = rows.withColumn("_above", above).withColumn("schema_level", F.greatest("_above", F.col("n_levels") - 1, F.lit(0)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_t", F.row_number().over(w)).withColumn("_slack", F.col("schema_level") - F.col("_t"))
    rows = rows.withColumn("depth", F.least(F.min("_slack").over(upto), F.lit(-1)) + F.col("_t"))
    # every section waits one level up for its parent: the last section of that level before it, whatever the level
    levels_of = F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(0).alias("asks")), F.struct((F.col("depth") - 1).alias("level"), F.lit(1).alias("asks"))))
    asked = rows.select("*", levels_of.alias("_l")).select("*", "_l.*")
    level = Window.partitionBy(doc, "level").orderBy(at, "asks").rowsBetween(Window.unboundedPreceding, -1)
    rows = asked.withColumn("parent_line", F.last(F.when(F.col("asks") == 0, F.col(at)), ignorenulls=True).over(level)).where("asks = 1")
    return rows.select(doc, at, "section_type", "number", "levels", "title_text", "contiguous", "schema_level", "depth", "parent_line")


def alineas(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Body lines with their section (its title line) and alinea number from 1; runs of table or list lines are one
    alinea, and so is a block quote if the lines have a ``quote_line``."""
    w = _order(doc, at)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = parts(lines, doc, at).where("part <> 'header' AND NOT document_element")
    rows = rows.withColumn("section_line", F.last(F.when(F.col("title"), F.col(at)), ignorenulls=True).over(upto))
    s = Window.partitionBy(doc, "section_line").orderBy(at)
    quote = F.col("quote_line") if "quote_line" in lines.columns else F.lit(None).cast("long")
    rows = rows.where("NOT title").withColumn("_quote", quote).withColumn("_before", F.lag("block").over(s)).withColumn("_quoted", F.lag("_quote").over(s))
    same_run = F.col("block").isin("table", "list") & (F.col("block") == F.col("_before")) & F.col("_quoted").isNull()
    opens = F.when(F.col("_quote").isNotNull(), F.when(F.col("_quote") == F.col("_quoted"), 0).otherwise(1)).when(same_run, 0).otherwise(1)
    return rows.withColumn("_opens", opens).withColumn("alinea", F.sum("_opens").over(s.rowsBetween(Window.unboundedPreceding, 0))).select(doc, at, "section_line", "alinea", "block")


def quote_depth(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Running depth of block quotes: a line with an odd number of quotes opens or closes one; even ones are inline."""
    odd = (F.length("folded") - F.length(F.replace("folded", F.lit('"'), F.lit("")))) % 2 == 1
    step = F.when(odd & F.col("folded").rlike(G.QUOTE_START), 1).when(odd & F.col("folded").rlike(G.QUOTE_END), -1).otherwise(0)
    upto = _order(doc, at).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_step", step).withColumn("quote_depth", F.sum("_step").over(upto)).drop("_step")


def list_parents(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """List lines with indentation and the line of the item they are nested in, within their run of list lines.

    One pass over the list lines in order with a stack of open items, so indentation and nesting have no bound.
    """
    w = _order(doc, at)
    rows = lines.withColumn("_is", F.col("block") == "list").withColumn("_new", F.when(F.col("_is") & F.lag("_is", 1, False).over(w), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_is")
    rows = rows.select(doc, at, "run", F.length(F.regexp_extract("folded", r"^(\s*)", 1)).alias("indent"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stack = None, []
        for batch in batches:
            parents = []
            for d, line, number, indent in zip(batch[doc], batch[at], batch["run"], batch["indent"], strict=True):
                if (d, number) != key:
                    key, stack = (d, number), []
                while stack and stack[-1][1] >= indent:
                    stack.pop()
                parents.append(stack[-1][0] if stack else None)
                stack.append((line, indent))
            yield batch.assign(parent_line=pd.array(parents, dtype="Int64"))

    kinds = dict(rows.dtypes)
    return rows.repartition(doc).sortWithinPartitions(doc, at).mapInPandas(run, f"`{doc}` {kinds[doc]}, `{at}` {kinds[at]}, run long, indent int, parent_line {kinds[at]}")


def table_cells(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Cells of table lines: run of the table, row, column and text; separator rows are marked."""
    w = _order(doc, at)
    rows = lines.withColumn("_is", F.col("block") == "table").withColumn("_new", F.when(F.col("_is") & F.lag("_is", 1, False).over(w), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_is")
    cells = F.split(F.regexp_replace(F.trim("contents"), r"^\|+|\|+$", ""), r"\|+")
    separator = F.col("contents").rlike(r"^[\s|:-]+$")
    row = F.row_number().over(Window.partitionBy(doc, "run").orderBy(at))
    return rows.withColumn("row", row).select(doc, at, "run", "row", separator.alias("separator"), F.posexplode(cells).alias("col", "cell")).withColumn("cell", F.trim("cell"))
