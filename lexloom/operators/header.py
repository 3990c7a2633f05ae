"""Elements of an order's header: runs of lines under one label, joined and split again; visas and motifs in three flavours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import grammar as G
from lexloom.operators.references import date_of
from lexloom.operators.segmentation import header_labels

LISTED = ("visa", "motif")
_OWN = {name: pattern.lstrip("^").replace(r"\W*", "", 1) for name, pattern in G.HEADERS.items()}


def _runs(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Header lines with their element and the number of the run of lines that has it."""
    w = Window.partitionBy(doc).orderBy(at)
    rows = header_labels(lines, doc, at)
    new = F.when(F.col("element") == F.lag("element").over(w), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def elements(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """(doc, run, element, piece, text): header elements but visas and motifs, in order.

    The lines of a run are joined with spans of one space and split again before each place where the element's own
    pattern begins, so an element that runs over lines is one piece and two on one line are two. Images stand alone.
    """
    rows = _runs(lines, doc, at).where(~F.col("element").isin(*LISTED) & (F.col("block") != "image"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.trim("contents").alias("t"), F.col("folded").alias("f"))))
    runs = rows.groupBy(doc, "run", "element").agg(ordered.alias("ls")).select(doc, "run", "element", F.array_join(F.transform("ls", lambda x: x["t"]), " ").alias("text"))
    marked = F.translate(F.lower("text"), G.FOLD_FROM, G.FOLD_TO)
    pieces: Column = F.array("text")
    for name, own in _OWN.items():
        if name in LISTED or name == "arrete_title":
            continue
        # offsets in the folded text are those of the text, so it is cut where the folded text is
        parts = F.split(F.regexp_replace(marked, rf"(?<![\p{{L}}\d])(?={own})", "\u0001"), "\u0001")
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
        cut = F.transform(parts, lambda p, i: F.substring(F.col("text"), F.get(F.col("_ends"), i) + 1, F.length(p)))
        runs = runs.withColumn("_ends", F.when(F.col("element") == name, ends).otherwise(F.col("_ends") if "_ends" in runs.columns else F.lit(None).cast("array<int>")))
        pieces = F.when(F.col("element") == name, cut).otherwise(pieces)
    out = runs.select(doc, "run", "element", F.posexplode(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")).alias("piece", "text"))
    return out


def titles(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """(doc, run, text, iso): the title of each order, its lines joined, with its first date."""
    found = elements(lines, doc, at).where("element = 'arrete_title'")
    return found.select(doc, "run", "text", date_of(F.translate(F.lower("text"), G.FOLD_FROM, G.FOLD_TO)).alias("iso"))


def visas_and_motifs(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """(doc, at, element, run, flavour, item, role) of the lines of visas and motifs.

    Flavours: simple (the keyword and its text on one line, lists below it belong to it), bullet_list (the keyword
    alone, then bullets; deeper ones belong to the one above), list (the keyword alone, then plain lines). Roles:
    keyword, item, nested (part of the item before), loose (between items) and image. A keyword on the last line of a
    header has no items.
    """
    rows = _runs(lines, doc, at).where(F.col("element").isin(*LISTED))
    folded = F.col("folded")
    hits = {n: folded.rlike(G.HEADERS[n]) for n in LISTED}
    own = F.when(F.col("element") == "visa", hits["visa"]).otherwise(hits["motif"])
    bare = F.when(F.col("element") == "visa", F.regexp_replace(folded, G.HEADERS["visa"], "")).otherwise(F.regexp_replace(folded, G.HEADERS["motif"], ""))
    rows = rows.withColumn("_own", own).withColumn("_list", F.col("block") == "list").withColumn("_indent", F.length(F.regexp_extract(folded, r"^(\s*)", 1)))
    run = Window.partitionBy(doc, "run").orderBy(at)
    rows = rows.withColumn("_n", F.row_number().over(run)).withColumn("_bare", F.trim(bare) == "")
    whole = Window.partitionBy(doc, "run")
    first = lambda c, n: F.max(F.when(F.col("_n") == n, c)).over(whole)
    flavour = F.when(~first(F.col("_bare"), 1), "simple").when(F.coalesce(first(F.col("_list"), 2), F.lit(False)), "bullet_list").otherwise("list")
    rows = rows.withColumn("flavour", flavour).withColumn("_indent0", first(F.col("_indent"), 2))
    role = (
        F.when((F.col("flavour") != "simple") & (F.col("_n") == 1), "keyword")
        .when(F.col("block") == "image", "image")
        .when(F.col("flavour") == "simple", F.when(F.col("_own"), "item").when(F.col("_list"), "nested").otherwise("loose"))
        .when(F.col("flavour") == "list", F.when(F.col("_list"), "nested").otherwise("item"))
        .otherwise(F.when(~F.col("_list"), "loose").when(F.col("_indent") > F.col("_indent0"), "nested").otherwise("item"))
    )
    rows = rows.withColumn("role", role).withColumn("item", F.count_if(F.col("role") == "item").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(doc, at, "element", "run", "flavour", F.when(F.col("role").isin("item", "nested"), F.col("item")).alias("item"), "role")


def document_elements(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """(doc, run, element, first_line, last_line): runs of page footers and of lines of contents, one element each."""
    w = Window.partitionBy(doc).orderBy(at)
    kind = F.when(F.col("document_element"), F.when(F.col("folded").rlike(G.FOOTER), "page_footer").otherwise("table_of_contents"))
    rows = lines.withColumn("element", kind).withColumn("_new", F.when(F.col("element").eqNullSafe(F.lag("element").over(w)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("element IS NOT NULL")
    return rows.groupBy(doc, "run", "element").agg(F.min(at).alias("first_line"), F.max(at).alias("last_line"))
