"""Queries of the training-text operators: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import canonical_list, contamination, entity_match, lookalikes, markup, mixing, scan_repair, text_quality
from lexloom.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


_TEXTS = (("segment", "text_segments", "seg_id", "contents"), ("register", "register_acts", "reg_id", "title"), ("cited", "cited_acts", "cite_id", "title"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disguisable texts of all three tables, one row per stored row."""
    parts = [
        table(spark, sf_dir, name).select(F.lit(src).alias("src"), F.col(key).alias("rec_id"), F.col(text).alias("text"))
        for src, name, key, text in _TEXTS
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.disguised(_texts(spark, sf_dir), ["src", "rec_id"], "text")


@query
def p1_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once with its plain form."""
    rows = _texts(spark, sf_dir).distinct()
    return lookalikes.unify(rows, "text", "plain").select("src", "rec_id", "plain")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.notation_lines(table(spark, sf_dir, "text_segments"), ["seg_id"], "contents", "code_aiot")


@query
def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = markup.clean_lines(table(spark, sf_dir, "text_segments"), "seg_id", "doc_id", "line_no", "contents", "code_aiot")
    return out.withColumn("notation", F.array_join("notation", " "))


@query
def p2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.wrappers(table(spark, sf_dir, "text_segments"), "code_aiot", "contents")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.noise(table(spark, sf_dir, "text_segments"))


@query
def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.paragraphs(table(spark, sf_dir, "text_segments"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _mentions(spark, sf_dir).where("code_cid IS NOT NULL")
    return mapped.withColumn("article_id", F.coalesce("article_id", F.lit("-")))


@query
def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions whose title, or whose article in a known code, has no entry."""
    misses = _mentions(spark, sf_dir).where("code_cid IS NULL OR article_id IS NULL")
    return misses.select("mention_id", "code_cid", F.when(F.col("code_cid").isNull(), "title").otherwise("article").alias("missing"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_list.map_mentions(*[table(spark, sf_dir, t) for t in ("code_mentions", "dim_codes", "dim_code_articles")])


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).where("reg_id IS NOT NULL").select("reg_id", "cite_id")


@query
def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation with the act it means, if any, and the confidence rounded to six places."""
    return _matches(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.match(table(spark, sf_dir, "cited_acts"), table(spark, sf_dir, "register_acts"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


@query
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, leaked spans cut out."""
    return contamination.without_leaks(table(spark, sf_dir, "documents"), _leaks(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of both mixtures, as often as drawn, in the order of the global shuffle."""
    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    return mixing.mix(sizes, mixing.plan(sizes, table(spark, sf_dir, "mix_targets")))


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source contributes to each mixture, against its target."""
    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    return mixing.shares(sizes, mixing.plan(sizes, table(spark, sf_dir, "mix_targets"))).withColumn("rate", F.round("rate", 6))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("form <> 'prose'").select("doc_id", "form")


@query
def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics, its distance from prose and each statistic's contribution."""
    out = _judged(spark, sf_dir)
    return out.select([F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
