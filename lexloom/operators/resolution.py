"""References resolved against small dimensions by left joins; a miss stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import fold
from lexloom.functions.uri import external_url


def resolve_codes(refs: DataFrame, codes: DataFrame, title: str) -> DataFrame:
    """``code_cid`` of a code by its folded title; of equal titles the first in cid order."""
    dim = codes.groupBy(fold(F.col("titre")).alias("_t")).agg(F.min("cid").alias("code_cid"))
    return refs.withColumn("_t", fold(F.col(title))).join(dim, "_t", "left").drop("_t")


def resolve_articles(refs: DataFrame, articles: DataFrame, cid: str, num: str) -> DataFrame:
    """``article_id`` of an article number within its code; the first of several."""
    dim = articles.groupBy(F.col("code_cid").alias(cid), F.col("num").alias(num)).agg(F.min("id").alias("article_id"))
    return refs.join(dim, [cid, num], "left")


def resolve_acts(refs: DataFrame, register: DataFrame) -> DataFrame:
    """``reg_id`` of a dated act by type, date and number; the first of several."""
    dim = register.groupBy("doc_type", "doc_date", "num").agg(F.min("reg_id").alias("reg_id"))
    return refs.join(dim, ["doc_type", "doc_date", "num"], "left")


def title_sample(following: str) -> Column:
    """The first four to sixteen words after a reference, up to a point or semicolon; empty where there are fewer."""
    return F.regexp_extract(F.col(following), r"^\s*((?:[^.;\s]+\s+){3,15}[^.;\s]+)", 1)


def resolve_titled(refs: DataFrame, lookup: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """``act_id`` of dated acts of some types. ``lookup``: doc_type, doc_date, num, title, id; the first id per key.

    A decree is found by date and number or title, an order or circular by date and the title after the reference
    (``following``): the lookup's title begins with that sample, or it with the title. Equality on type and date comes
    first, so a title is compared with the acts of one day only. A miss stays null.
    """
    mine = refs.where(F.col("doc_type").isin(*types) & F.col("doc_date").isNotNull()).withColumn("_s", F.trim(fold(title_sample("following"))))
    dim = lookup.select("doc_type", "doc_date", F.col("num").alias("_num"), F.trim(fold(F.col("title"))).alias("_t"), F.col("id").alias("_id"))
    titled = (F.col("_s") != "") & (F.startswith("_t", F.col("_s")) | F.startswith("_s", F.col("_t")))
    numbered = (F.col("doc_type") == "decret") & F.coalesce(F.col("num") == F.col("_num"), F.lit(False))
    hits = mine.join(dim, ["doc_type", "doc_date"]).where(F.coalesce(titled, F.lit(False)) | numbered).groupBy("ref_key").agg(F.min("_id").alias("act_id"))
    return refs.join(hits, "ref_key", "left")


def resolve_eu(refs: DataFrame, lookup: DataFrame) -> DataFrame:
    """``act_id`` of European acts: the address found by type, year and number; the first of several."""
    dim = lookup.groupBy("doc_type", "year", "num").agg(F.min("url").alias("_url"))
    found = refs.join(dim, ["doc_type", "year", "num"], "left")
    old = F.col("act_id") if "act_id" in refs.columns else F.lit(None).cast("string")
    return found.withColumn("act_id", F.coalesce(F.when(F.col("doc_type").startswith("eu-"), F.col("_url")), old)).drop("_url")


NATIONAL = ("arrete-ministeriel", "decret", "circulaire")  # in the order in which they are resolved


def resolve_all(refs: DataFrame, acts: DataFrame | None = None, codes: DataFrame | None = None, eu: DataFrame | None = None) -> DataFrame:
    """The resolution steps in order: national acts and codes, then European acts. A step without its lookup is left out.

    ``refs``: ref_key, doc_type, num, doc_date, year, title, following. Adds ``act_id`` and ``url``.
    """
    out = refs.withColumn("act_id", F.lit(None).cast("string"))
    if acts is not None:
        out = resolve_titled(out.drop("act_id"), acts, NATIONAL)
    if codes is not None:
        named = resolve_codes(out, codes, "title")
        out = named.withColumn("act_id", F.coalesce("act_id", F.when(F.col("doc_type") == "code", F.col("code_cid")))).drop("code_cid")
    if eu is not None:
        out = resolve_eu(out, eu)
    return out.withColumn("url", external_url(F.col("doc_type"), F.col("act_id"), F.lit(None).cast("string")))


def cached_lookups(spark: SparkSession, path: str) -> DataFrame:
    """A cache of lookups as rows: function, arguments and value (null for a known miss). The file is one JSON object of
    objects, as a service client writes it: {function: {"(arguments)": value}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("c"))
    return whole.select(F.explode("c").alias("function", "entries")).select("function", F.explode("entries").alias("arguments", "value"))


def through_cache(calls: DataFrame, cache: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``calls`` (function, arguments) with ``value`` and ``known``: from the cache, else from ``fallback`` (the same columns)."""
    hits = calls.join(cache.withColumn("known", F.lit(True)), ["function", "arguments"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    if fallback is None:
        return hits
    more = fallback.select("function", "arguments", F.col("value").alias("_v"))
    return hits.join(more, ["function", "arguments"], "left").withColumn("value", F.when(F.col("known"), F.col("value")).otherwise(F.col("_v"))).drop("_v")
