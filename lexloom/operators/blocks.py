"""Tables, their descriptions and images of orders as elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DESCRIPTION = r"^\s*\(?\*+"
SEPARATOR = r"^\s*\|?(?:\s*:?-+:?\s*\|)+\s*(?::?-+:?\s*)?$"


def escaped(text: Column) -> Column:
    """A text as HTML holds it."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cells(line: Column) -> Column:
    """The cells of a table line, without the bars at its ends."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def column_names(header: Column) -> Column:
    """Names of the columns of a header line, what is in parentheses left out."""
    return F.filter(F.transform(cells(header), lambda c: F.trim(F.regexp_replace(c, r"\([^)]*\)", ""))), lambda c: c != "")


def is_description(line: Column, header: Column) -> Column:
    """Whether a line below a table describes it: it begins with asterisks, or names a column followed by a colon."""
    named = F.exists(column_names(header), lambda c: F.contains(F.lower(line), F.concat(F.lower(c), F.lit(" :"))))
    return line.rlike(DESCRIPTION) | F.coalesce(named, F.lit(False))


def tables(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """One row per table: doc, first_line, last_line (with its description), rows, html and error.

    A run of table lines is one table; lines that describe it follow it, each after a line break. A run whose second
    line does not separate a header of as many cells is no table: its error is markdown_parsing, its lines stay as text.
    """
    w = Window.partitionBy(doc).orderBy(at)
    table = F.col("block") == "table"
    rows = lines.where("contents IS NOT NULL").withColumn("_t", table).withColumn("_new", F.when(F.col("_t") & ~F.coalesce(F.lag("_t").over(w), F.lit(False)), 1).otherwise(0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("_new").over(upto)).where("run > 0")
    run = Window.partitionBy(doc, "run").orderBy(at)
    rows = rows.withColumn("_header", F.first("contents").over(run)).withColumn("_part", F.when(F.col("_t"), "row").when(is_description(F.col("contents"), F.col("_header")), "description"))
    # what no longer belongs to the table ends it
    rows = rows.withColumn("_out", F.max(F.col("_part").isNull().cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))).where("_out = 0")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("_part").alias("part"), F.col("contents").alias("text"))))
    made = rows.groupBy(doc, "run").agg(ordered.alias("ls")).select(doc, "ls", F.transform(F.filter("ls", lambda x: x["part"] == "row"), lambda x: x["text"]).alias("rows"), F.transform(F.filter("ls", lambda x: x["part"] == "description"), lambda x: x["text"]).alias("notes"))
    second = F.try_element_at("rows", F.lit(2))
    valid = F.coalesce(second.rlike(SEPARATOR) & (F.size(cells(second)) == F.size(cells(F.get("rows", 0)))), F.lit(False))
    tr = lambda line, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(line), lambda c: F.concat(F.lit(f"<{tag}>"), escaped(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice("rows", F.lit(3), F.greatest(F.size("rows") - 2, F.lit(0))), lambda x: tr(x, "td")), "")
    notes = F.array_join(F.transform("notes", lambda x: F.concat(F.lit("<br>"), escaped(F.trim(x)))), "")
    html = F.concat(F.lit("<table><thead>"), tr(F.get("rows", 0), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"), notes)
    return made.select(doc, F.get("ls", 0)["at"].alias("first_line"), F.element_at("ls", -1)["at"].alias("last_line"), F.size("rows").alias("rows"), F.when(valid, html).alias("html"), F.when(~valid, "markdown_parsing").alias("error"))


def images(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Image lines with ``alt`` and ``src``."""
    pattern = r"^!\[([^\[\]]+)\]\(([^()]+)\)"
    rows = lines.where("block = 'image'")
    return rows.select(doc, at, F.regexp_extract("contents", pattern, 1).alias("alt"), F.regexp_extract("contents", pattern, 2).alias("src"))


def quoted(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Inline quotes of the lines in their original letters: keys, ordinal from 0, quoted. Offsets of folded text are those of the text."""
    parts = F.split("folded", '"', -1)
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) + 1)))
    rows = lines.where(F.contains("folded", F.lit('"'))).select(*keys, "contents", parts.alias("_p"), starts.alias("_s"))
    inner = F.filter(F.transform("_p", lambda p, i: F.struct(i.alias("i"), F.substring(F.col("contents"), F.get(F.col("_s"), i) + 1, F.length(p)).alias("t"))), lambda x: (x["i"] % 2 == 1) & (x["i"] < F.size("_p") - 1) & (x["t"] != ""))
    return rows.select(*keys, F.posexplode(F.transform(inner, lambda x: x["t"])).alias("ordinal", "quoted"))
