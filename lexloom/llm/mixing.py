"""Sources mixed to target shares by Poisson replication.

Each record appears as often as an inverted Poisson distribution says at a uniform number seeded by its hash; the mean
rate of a source is the one at which its records add up to the wanted tokens under the cap on repeats. Rates are solved
from token sums per hash bucket, which are bounded by the targets, never by the records.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # ranks of a public byte-level BPE; a path, never a copy
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of that tokenizer
BUCKETS = 4096  # hash buckets of a source from which its rate is solved
SEED = 20240131
PIECE = 100_000  # characters from which a long text is cut where its tokens cannot span; see ``pieces``

_WORD_END = regex.compile(r"(?<=\p{L})(?=\s)")


def pieces(text: str) -> Iterator[str]:
    """A text in parts whose tokens together are its own: PATTERN never joins a letter and a space behind it, and looks
    ahead only. A part runs on until such a place, however far it is."""
    at = 0
    while len(text) - at > PIECE:
        m = _WORD_END.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def tokens_of(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a whole text under the tokenizer at ``path``; 0 for null."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([0 if t is None else sum(len(coder.encode_ordinary(part)) for part in pieces(t)) for t in batch], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)


def source_name(raw: Column) -> Column:
    """One spelling of a source: trimmed, lower case, separators as underscores."""
    return F.regexp_replace(F.lower(F.trim(raw)), r"[\s_-]+", "_")


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) seeded by a hash of the keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(SEED)), 11).cast("double") + 0.5) / float(2**53)


def poisson_steps(rate: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0 .. cap-1 copies: a record with uniform number u gets as many copies as lie below u."""
    terms = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else float(k == 0) for k in range(cap)]
    return [min(1.0, x) for x in accumulate(terms)]


def solve_rate(buckets: dict[int, int], wanted: float, cap: int) -> float:
    """The mean rate at which records in these hash buckets reach ``wanted`` tokens; infinite if the cap forbids it."""
    if wanted <= 0 or cap <= 0:
        return 0.0
    if sum(buckets.values()) * cap <= wanted:
        return math.inf

    def reached(rate: float) -> int:
        steps = poisson_steps(rate, cap)
        return sum(n * bisect_left(steps, (b + 0.5) / BUCKETS) for b, n in buckets.items())

    low, high = 0.0, 1.0
    while reached(high) < wanted:
        low, high = high, high * 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if reached(mid) < wanted else (low, mid)
    return (low + high) / 2


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source in one spelling, tokens; each document once (of rows that differ the one least by source and tokens)."""
    docs = documents.select(F.col("doc_id").cast("long"), source_name(F.col("source")).alias("source"), tokens_of(F.col("text"), path).alias("tokens"))
    return cut(docs.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens"))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with what each can reach: rate, steps, wanted and available tokens. As many rows as targets."""
    spark = sizes.sparkSession
    goals = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", F.col("max_repeats").cast("int"), "size_factor")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    drawn = sizes.join(F.broadcast(goals.select("mix_name", "source")), "source")
    bucket = F.floor(uniform(F.col("mix_name"), F.col("doc_id")) * BUCKETS).cast("int")
    sums = drawn.groupBy("mix_name", "source", bucket.alias("b")).agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect()
    have: dict[tuple, dict[int, int]] = {}
    docs: dict[tuple, int] = {}
    for r in sums:
        have.setdefault((r["mix_name"], r["source"]), {})[r["b"]] = r["n"]
        docs[r["mix_name"], r["source"]] = docs.get((r["mix_name"], r["source"]), 0) + r["docs"]
    rows = []
    for g in goals.collect():
        key = (g["mix_name"], g["source"])
        wanted = g["target_share"] * g["size_factor"] * total
        rate = solve_rate(have.get(key, {}), wanted, g["max_repeats"])
        steps = [0.0] * g["max_repeats"] if math.isinf(rate) else poisson_steps(rate, g["max_repeats"])
        rows.append((*key, g["target_share"], g["max_repeats"], float(wanted), docs.get(key, 0), sum(have.get(key, {}).values()), rate, steps))
    schema = "mix_name string, source string, target_share double, max_repeats int, wanted_tokens double, source_docs long, source_tokens long, rate double, steps array<double>"
    return spark.createDataFrame(rows, schema)


def mix(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """The sample: mix_name, source, doc_id, copy (from 1), tokens and its place ``shuffle_key`` in the global shuffle.

    Rows come range-partitioned and sorted by (mix_name, shuffle_key), so reading them in order is a global shuffle.
    """
    u = uniform(F.col("mix_name"), F.col("doc_id"))
    copies = F.size(F.filter("steps", lambda s: s < u))
    drawn = sizes.join(F.broadcast(planned.select("mix_name", "source", "steps")), "source").withColumn("copies", copies).where("copies > 0")
    out = drawn.select("mix_name", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens")
    out = out.withColumn("shuffle_key", F.xxhash64("mix_name", "doc_id", "copy", F.lit(SEED + 1)))
    return out.orderBy("mix_name", "shuffle_key", "doc_id", "copy")


def shares(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """Reached against wanted for every target, also for sources without documents."""
    u = uniform(F.col("mix_name"), F.col("doc_id"))
    copies = F.size(F.filter("steps", lambda s: s < u))
    drawn = sizes.join(F.broadcast(planned.select("mix_name", "source", "steps")), "source").withColumn("copies", copies)
    got = drawn.groupBy("mix_name", "source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("sampled_tokens"), F.sum("copies").alias("sampled_records"), F.max("copies").alias("most_repeats")
    )
    totals = got.groupBy("mix_name").agg(F.sum("sampled_tokens").alias("all"))
    zero = F.lit(0).cast("long")
    return (
        planned.drop("steps").join(F.broadcast(got), ["mix_name", "source"], "left").join(F.broadcast(totals), "mix_name", "left")
        .select(
            "mix_name", "source", "target_share", "max_repeats", "wanted_tokens", "source_docs", "source_tokens", "rate",
            F.coalesce("sampled_records", zero).alias("sampled_records"), F.coalesce("sampled_tokens", zero).alias("sampled_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.round(F.coalesce(F.col("sampled_tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"),
            F.round(F.coalesce(F.col("sampled_tokens") * F.col("target_share") / F.col("wanted_tokens"), F.lit(0.0)), 6).alias("share_of_wanted_size"),
            (F.col("source_tokens") * F.col("max_repeats") < F.col("wanted_tokens")).alias("short"),
        )
    )
