"""Readers of order files and the HTML sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder (any depth): doc_id (file stem), path, text. Image data stays in the text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[mM][dD]$", 1).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files named by number, ordered 1, 2, 10: doc_id (folder), page, text; files without a number are left out."""
    files = read_markdown(spark, path).withColumn("page", F.expr("try_cast(doc_id AS int)")).where("page IS NOT NULL")
    return files.select(F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("doc_id"), "page", "text")


def pages_to_lines(pages: DataFrame) -> DataFrame:
    """Lines of all pages of a document numbered through in page order."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("at", "contents"))
    counted = pages.select("doc_id", "page", F.size(F.split("text", "\n", -1)).alias("n"))
    ahead = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("doc_id", "page", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    return rows.join(starts, ["doc_id", "page"]).select("doc_id", "page", (F.col("start") + F.col("at")).alias("line_no"), "contents")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """PDF files as bytes: doc_id, path, content. Recognition itself is a pluggable step upstream."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[pP][dD][fF]$", 1).alias("doc_id"), "path", "content")


def inline_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Image placeholders ``![id](id)`` of recognised pages replaced by their data. ``images``: doc_id, page, id, data."""
    own = images.groupBy("doc_id", "page").agg(F.collect_list(F.struct("id", "data")).alias("images"))
    swap = F.aggregate("images", F.col("text"), lambda t, i: F.replace(t, F.concat(F.lit("!["), i["id"], F.lit("]("), i["id"], F.lit(")")), F.concat(F.lit("!["), i["id"], F.lit("]("), i["data"], F.lit(")"))))
    return pages.join(own, ["doc_id", "page"], "left").select("doc_id", "page", F.when(F.col("images").isNull(), F.col("text")).otherwise(swap).alias("text"))


def read_register_csv(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon-separated register with a header; a byte-order mark before the first name is dropped."""
    rows = spark.read.option("sep", ";").option("header", "true").csv(path)
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])


# Names of files in the register's document lists, and the kinds they stand for.
FILE_KINDS = {
    "ap d'autorisation": "AP",
    "ap enregistrement": "AP",
    "ap autorisation temporaire": "AP",
    "arrêté préfectoral": "AP",
    "ap servitude d'utilité publique": "AP",
    "ap prescriptions complémentaires": "APC",
    "arrêté de mise en demeure": "APMD",
    "ap mise en demeure": "APMD",
    "ap levée de mise en demeure": "APMD",
    "ap mesures d'urgence": "APMU",
    "autre": "Autre",
}


def file_kind(name: Column) -> Column:
    """The kind of a listed document; null for kinds that are not taken."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FILE_KINDS.items() for x in kv]), F.lower(F.trim(name)))


def nested_html(lines: DataFrame, doc: str = "doc_id", at: str = "line_no") -> DataFrame:
    """One HTML text per document with sections nested by ``depth``.

    ``lines``: part, title, depth (of titles, from 0), html (of other lines) and contents. A title closes the sections
    down to its depth and opens its own; each part closes what it opened.
    """
    w = Window.partitionBy(doc, "part").orderBy(at)
    before = F.coalesce(F.last("depth", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    last = F.coalesce(F.last("depth", ignorenulls=True).over(Window.partitionBy(doc, "part").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(-1))
    level = F.least(F.col("depth") + 2, F.lit(6)).cast("string")
    opened = F.concat(F.repeat(F.lit("</section>"), F.greatest(F.col("_before") - F.col("depth") + 1, F.lit(0))), F.lit('<section class="dsr-section"><h'), level, F.lit(">"), F.col("html"), F.lit("</h"), level, F.lit(">"))
    rows = lines.withColumn("_before", before).withColumn("_last", last).withColumn("_node", F.when(F.col("depth").isNotNull(), opened).otherwise(F.concat(F.lit("<div>"), F.col("html"), F.lit("</div>"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("_node").alias("n")))), lambda x: x["n"]), "")
    rank = F.when(F.col("part") == "header", 0).when(F.col("part") == "main", 1).otherwise(2)
    parts = rows.groupBy(doc, "part").agg(body.alias("b"), F.max("_last").alias("l"))
    tags = parts.select(doc, F.struct(rank.alias("r"), F.concat(F.lit("<"), "part", F.lit('>'), "b", F.repeat(F.lit("</section>"), F.col("l") + 1), F.lit("</"), "part", F.lit(">")).alias("h")).alias("p"))
    return tags.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["h"]), "").alias("html"))


def render_html(lines: DataFrame, doc: str = "doc_id", at: str = "line_no") -> DataFrame:
    """One semantic HTML text per document from labelled lines (``part``, ``element``, ``contents``)."""
    escaped = F.replace(F.replace(F.replace(F.col("contents"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    node = F.concat(F.lit('<div class="dsr-'), F.col("element"), F.lit('">'), escaped, F.lit("</div>"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), node.alias("html")))), lambda x: x["html"])
    parts = lines.groupBy(doc, "part").agg(F.array_join(body, "\n").alias("html"))
    rank = F.create_map(F.lit("header"), F.lit(0), F.lit("main"), F.lit(1), F.lit("appendix"), F.lit(2))
    tag = F.concat(F.lit("<"), F.col("part"), F.lit(' class="dsr-'), F.col("part"), F.lit('">\n'), F.col("html"), F.lit("\n</"), F.col("part"), F.lit(">"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct(rank[F.col("part")].alias("r"), tag.alias("html")))), lambda x: x["html"])
    return parts.groupBy(doc).agg(F.array_join(whole, "\n").alias("html"))


def save_html(rendered: DataFrame, path: str) -> None:
    """Write one row per document as parquet with the text; readers split it into files if they need to."""
    rendered.write.mode("overwrite").parquet(path)
