"""The whole pipeline over files, with an errors table, and its command line.

    spark-submit --py-files lexloom.zip -m lexloom.pipeline -i ORDERS -o OUT [--acts ACTS] [--eu ACTS] [--codes CODES] [-v]
"""

from __future__ import annotations

import argparse
import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import Step, run_pipeline
from lexloom.functions import text
from lexloom.operators import blocks, lines, quotes, references, resolution, segmentation
from lexloom.runtime import cut
from lexloom.sources import files

log = logging.getLogger("lexloom")

# Codes of errors.
CODES = ("markdown_parsing", "unbalanced_quote", "non_contiguous_titles", "law_data_api_error", "non_existant_date", "unsupported_act", "unreadable_file")


@dataclass(frozen=True)
class Settings:
    """What a run is told: the lookup tables it resolves with (a step without its table is left out) and the year by which
    two-figure years are read. The environment gives defaults: LEXLOOM_ACTS, LEXLOOM_CODES, LEXLOOM_EU, LEXLOOM_AS_OF_YEAR."""

    acts: str | None = None
    codes: str | None = None
    eu: str | None = None
    as_of_year: int = 2025

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        return cls(*[env.get(f"LEXLOOM_{n}") or None for n in ("ACTS", "CODES", "EU")], int(env.get("LEXLOOM_AS_OF_YEAR", "2025")))


@dataclass
class Result:
    """What the pipeline makes of orders: tables with one key, ``doc_id``."""

    lines: DataFrame
    sections: DataFrame
    references: DataFrame
    operations: DataFrame
    html: DataFrame
    errors: DataFrame


def cleaned(rows: DataFrame) -> DataFrame:
    """The cleaning step: every line cleaned, lines of punctuation dropped, places kept."""
    return text.clean(rows, "contents").where(text.useful(F.col("contents")))


def segmented(rows: DataFrame) -> DataFrame:
    """The segmentation step: features, quotes and the titles that begin sections."""
    return quotes.own_titles(quotes.with_quotes(lines.featured(rows), "doc_id", "line_no"), "doc_id", "line_no")


DEFAULT: tuple[Step, ...] = (cleaned, segmented)


def errors_of(rows: DataFrame, sections: DataFrame, dated: DataFrame, tables: DataFrame, acts: DataFrame) -> DataFrame:
    """(doc_id, line_no, code): every error of the steps as a row, so that no document stops a run."""
    one = lambda df, at, code: df.select("doc_id", F.col(at).cast("long").alias("line_no"), F.lit(code).alias("code"))
    found = one(rows.where("unbalanced"), "line_no", "unbalanced_quote")
    found = found.unionByName(one(sections.where("NOT coalesce(contiguous, false)"), "line_no", "non_contiguous_titles"))
    found = found.unionByName(one(dated.where("NOT exists"), "line_no", "non_existant_date"))
    found = found.unionByName(one(tables.where("error IS NOT NULL"), "first_line", "markdown_parsing"))
    return found.unionByName(one(acts.where("error IS NOT NULL"), "line_no", "unsupported_act"))


def process(rows: DataFrame, steps: tuple[Step, ...] = DEFAULT, acts: DataFrame | None = None, codes: DataFrame | None = None, eu: DataFrame | None = None, as_of_year: int = 2025) -> Result:
    """Clean, segment, detect, resolve (where a lookup is given) and consolidate. ``rows``: doc_id, line_no, contents.

    Defined cases: null contents are dropped by cleaning; an empty table gives empty results; extra columns pass through.
    """
    own = cut(run_pipeline(rows.where("contents IS NOT NULL"), list(steps)))
    sections = segmentation.titles(own, "doc_id", "line_no")
    keys = ["doc_id", "line_no"]
    found = cut(references.detect(own, keys))
    national = references.acts(found, keys, as_of_year).select(*keys, "kind", "ordinal", "member", "doc_type", "num", "doc_date", F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("error"))
    european = references.eu_acts(found, keys).select(*keys, F.lit("eu").alias("kind"), "ordinal", F.lit(0).alias("member"), "doc_type", "num", F.lit(None).cast("string").alias("doc_date"), "year", "error")
    cited = national.unionByName(european)
    after = own.select(*keys, F.regexp_extract("folded", r"\d{4}\s+(.*)$", 1).alias("following"))
    keyed = cited.join(after, keys).withColumn("ref_key", F.concat_ws("/", *keys, "kind", "ordinal", "member")).withColumn("title", F.lit(None).cast("string"))
    resolved = resolution.resolve_all(keyed, acts, codes, eu).drop("ref_key", "title", "following")
    operations = references.operations(own, keys)
    parted = segmentation.parts(own, "doc_id", "line_no").join(sections.select("doc_id", "line_no", "depth"), keys, "left")
    html = files.nested_html(parted.withColumn("html", blocks.escaped(F.col("contents"))))
    tables = blocks.tables(own, "doc_id", "line_no")
    errors = errors_of(own, sections, references.dates(own, keys, as_of_year=as_of_year), tables, references.eu_acts(found, keys))
    return Result(own, sections, resolved, operations, html, errors)


def normalized_html(html: str) -> str:
    """HTML without what may differ between equal renderings: spaces between tags, order of attributes, generated ids."""
    import re

    def tag(m: re.Match) -> str:
        attributes = sorted(a for a in re.findall(r'[\w-]+="[^"]*"', m[2]) if not a.startswith(("data-element_id", "data-group_id")))
        return f"<{m[1]}{''.join(' ' + a for a in attributes)}>"

    return re.sub(r">\s+<", "><", re.sub(r"<(\w+)((?:\s+[\w-]+=\"[^\"]*\")*)\s*>", tag, html)).strip()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Read orders (Markdown; PDF files only as rows of the errors table, as recognition is a step upstream), write all tables."""
    parser = argparse.ArgumentParser(prog="lexloom")
    parser.add_argument("-i", "--input", required=True, help="a Markdown file, or a folder of them at any depth")
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("-v", "--verbose", action="store_true")
    settings = Settings.from_env()
    for lookup in ("acts", "codes", "eu"):
        parser.add_argument(f"--{lookup}", default=getattr(settings, lookup), help=f"parquet table that {lookup} are resolved with; without it that step is left out")
    args = parser.parse_args(arguments)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = spark or SparkSession.builder.getOrCreate()
    documents = files.read_markdown(spark, args.input)
    rows = lines.explode_lines(documents, keep_newline=True)
    lookups = {n: spark.read.parquet(p) if (p := getattr(args, n)) else None for n in ("acts", "codes", "eu")}
    log.info("resolving with: %s", ", ".join(n for n, t in lookups.items() if t is not None) or "nothing")
    out = process(rows, **lookups, as_of_year=settings.as_of_year)
    unread = files.read_pdf(spark, args.input).select("doc_id", F.lit(None).cast("long").alias("line_no"), F.lit("unreadable_file").alias("code"))
    for name, table in {**vars(out), "errors": out.errors.unionByName(unread)}.items():
        table.write.mode("overwrite").parquet(f"{args.output}/{name}")
        log.info("wrote %s", name)


if __name__ == "__main__":
    main()
