"""Per-document text statistics, and by them running prose against lists, tables and junk.

Each document's statistics are compared with the prose of its own language: robust Mahalanobis distance from a mean
and covariance that are re-estimated on the inliers only, with every statistic's contribution to the distance. Only
sums of products per language reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.runtime import cut

# the statistics the distance is taken over; those of the running text leave list entries and table rows out
TEXT_STATS = ("word_length", "symbols", "digits", "common", "repeated", "sentences", "odd_words")
SHAPE_STATS = ("log_words", "log_lines", "mean_word_length", "lines_with_end")  # of the whole text; they tell long from short rather than prose from junk
STATS = (*TEXT_STATS, *SHAPE_STATS, "list_share", "table_share")
# the least scale of each statistic: differences below it mean nothing
FLOOR = {
    "word_length": 0.25, "symbols": 0.012, "digits": 0.02, "common": 0.04, "repeated": 0.03, "sentences": 0.12, "odd_words": 0.015,
    "log_words": 1.0, "log_lines": 1.0, "mean_word_length": 0.5, "lines_with_end": 0.3, "list_share": 0.05, "table_share": 0.05,
}
ENTRY_WORDS = 12  # an unmarked line of more words is no entry but text
ENTRY_SENTENCES = 2  # a marked line of more sentences is text with a mark before it
EVERY = "*"  # the group of documents of no known language: they are compared with the prose of all
RIDGE = 0.05  # added to the diagonal of a correlation-scaled covariance
STEPS = 3  # re-estimations on the inliers
INLIER = 27.7  # squared distance within which a document helps to estimate prose (99 % of a chi-square with 13 degrees)
OUTLIER = 60.0  # squared distance beyond which a document is not prose
LEAST_DOCS = 20  # documents from which a language has statistics of its own

_WORD = re.compile(r"[^\W\d_]+")
_CELLS = re.compile(r"\t|\||;\S|,\S|\S  ")
_MARKED = re.compile(r"^\s*(?:[-*•–—▪◦·>+‣●○■□➢✓]\s*|\(?\d{1,3}(?:\.\d{1,3})*[.)°]\s+|\(?[A-Za-z][.)]\s+|[ivxIVX]{1,5}[.)]\s+)\S")
_GAP = re.compile(r"\S {2,}(?=\S)")
_BAR = re.compile(r"(?:^|\s)\|(?=\s|$)")
_END_SIGNS = frozenset(".;:!?…»\")")
_BREAK = re.compile(r"(?<=[.;!?])\s+")
_STOP = re.compile(r"[.!?…»\"]\s*$")
_VOWEL = re.compile(r"[aeiouyàâäéèêëîïôöùûüœæ]")
_UNUSUAL = re.compile(r"[^\w\s.,;:!?'’\"«»()°%/²³µ–—-]")
_DIGIT = re.compile(r"\d")
_USUAL = re.compile(r"[«\"(\[]*(?:[^\W\d_A-ZÀ-Þ]{1,25}|[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ]{0,24}|[A-ZÀ-Þ]{2,25})(?:['’–-]+[^\W\d_]{1,25})*[.,;:!?)\"»\]]*|[\d.,/:-]{1,25}")
_ODD = re.compile(r"[^\W\d_]\d|\d[^\W\d_]{3}|[^\W\d_][^\w\s.,;:!?'’\"«»()°%/²³µ–—@&+*=<>|\[\]{}#~-]|[^\w\s'’\"«»(\[{.,;:!?°%/–—@&+*=<>#~-][^\W\d_]|.{26}|[a-zà-ÿ][A-ZÀ-Þ][A-Za-z]*[a-z]")


def _table_row(line: str) -> str | None:
    """The separator by which a line reads as a row of cells, if it does."""
    if not _CELLS.search(line):
        return None
    if line.count("\t") >= 2:
        return "\t"
    if sum(map(str.isalnum, line)) * 4 < len(line.strip()):
        return None
    if len(_BAR.findall(line)) >= 2:
        return "|"
    if line.count(";") >= 3 and len(line) < 40 * line.count(";") and line.count("; ") * 2 < line.count(";"):
        return ";"
    if line.count(",") >= 3 and line.count(", ") * 3 < line.count(",") and len(line) < 25 * (line.count(",") + 1):
        return ","
    gaps = len(_GAP.findall(line))
    if gaps >= 2 or gaps == 1 and len(line.split()) <= 6:
        return " "
    return None


def _readable(words: list[str]) -> bool:
    """Whether most words have vowels where words have them: entries, not noise."""
    return sum(bool(_VOWEL.search(w)) or len(w) < 4 for w in words) >= 0.8 * len(words)


def split_forms(text: str, common: set[str]) -> tuple[str, int, int, int, list[str]]:
    """(running text, characters of list entries, of table rows, of all lines, the non-blank lines)."""
    lines = [x for x in text.splitlines() if x.strip()]
    kinds: list[str] = []
    rows = [_table_row(x) for x in lines] if _CELLS.search(text) else [None] * len(lines)
    for i, line in enumerate(lines):
        near = (i and rows[i - 1] == rows[i]) or (i + 1 < len(lines) and rows[i + 1] == rows[i])
        if rows[i] and (near or rows[i] in "\t|"):
            kinds.append("table")
        elif _MARKED.match(line) and sum(map(str.isalnum, line)) * 3 > len(line.strip()) and sum(x.count(" ") >= 4 for x in _BREAK.split(line)) <= ENTRY_SENTENCES:
            kinds.append("list")
        else:
            kinds.append("")
    i = 0
    while i < len(lines):  # unmarked entries: runs of short lines that make no sentences
        j = i
        while j < len(lines) and not kinds[j] and lines[j].count(" ") < ENTRY_WORDS:
            j += 1
        if j - i >= 3:
            part = lines[i:j]
            body = part[1:] if part[0].rstrip().endswith(":") else part
            words = [w for x in body for w in _WORD.findall(x.lower())]
            lower = sum(x.lstrip()[:1].islower() for x in body) / len(body)
            ended = sum(bool(_STOP.search(x)) for x in body) / len(body)
            shouted = sum(x.isupper() for x in body) / len(body)
            usual = sum(w in common for w in words) / max(len(words), 1)
            brief = len(words) / len(body) <= 6
            varied = len(set(part)) > 0.2 * len(part) and len(words) >= len(body) / 2
            if lower < 0.2 and ended < 0.25 and brief and varied and (usual < 0.22 or shouted < 0.5) and _readable(words):
                kinds[i:j] = ["list"] * (j - i)
        i = max(j, i + 1)
    chars = {k: sum(len(x) for x, y in zip(lines, kinds, strict=True) if y == k) for k in ("list", "table", "")}
    running = "\n".join(x for x, y in zip(lines, kinds, strict=True) if not y)
    return running, chars["list"], chars["table"], sum(chars.values()), lines


_SEEN: dict[str, tuple] = {}  # what a token holds; tokens recur across documents
_SEEN_BOUND = 300_000


def _token(token: str) -> tuple:
    """(words in lower case, their letters, unusual signs, digits, odd or not) of one token."""
    hit = _SEEN.get(token)
    if hit is None:
        if len(_SEEN) > _SEEN_BOUND:
            _SEEN.clear()
        words = tuple(_WORD.findall(token.lower()))
        odd = not _USUAL.fullmatch(token) and bool(_ODD.search(token))
        hit = (words, sum(map(len, words)), len(_UNUSUAL.findall(token)), len(_DIGIT.findall(token)), odd)
        if len(token) < 60:
            _SEEN[token] = hit
    return hit


def _profile(text: str) -> tuple[dict[str, int], int, int, int, int, int]:
    """Word counts, letters, unusual signs, digits, odd tokens and tokens of a text."""
    words: dict[str, int] = defaultdict(int)
    letters = signs = digits = odd = 0
    tokens = text.split()
    seen = _SEEN.get
    for token, k in Counter(tokens).items():
        own, n, u, d, o = seen(token) or _token(token)
        for w in own:
            words[w] += k
        letters += n * k
        if u or d or o:
            signs += u * k
            digits += d * k
            odd += o * k
    return words, letters, signs, digits, odd, len(tokens)


def statistics(text: str | None, common: dict[str, set[str]], every: set[str]) -> dict:
    """All statistics of one text; ``every`` is the union of the languages' common words."""
    text = text or ""
    running, in_list, in_table, total, lines = split_forms(text, every)
    whole = _profile(text)
    n_all = sum(whole[0].values())
    body = running if len(running) >= 0.2 * max(total, 1) else text
    tally, letters, signs, digits, odd, tokens = whole if in_list + in_table == 0 or body is text else _profile(body)
    words = sum(tally.values())
    n = max(words, 1)
    known = {lang: sum(tally[w] for w in usual & tally.keys()) / n for lang, usual in common.items()}
    lang = max(known, key=lambda k: (known[k], k)) if known else None
    chars = max(len(body), 1)
    flow = " ".join(body.split("\n"))
    said = Counter(_BREAK.split(flow.rstrip()))
    in_sentences = sum(len(s) * k for s, k in said.items() if 4 <= s.count(" ") and len(s) < 15 * (s.count(" ") + 1) and s[-1] in ".;!?")
    again = sum(len(s) * k for s, k in said.items() if k > 3) / chars
    top = max(tally.values(), default=0) / n
    return {
        "words": n_all,
        "lines": len(lines),
        "log_words": math.log1p(n_all),
        "log_lines": math.log1p(len(lines)),
        "mean_word_length": min(whole[1] / max(n_all, 1), 20.0),
        "lines_with_end": sum(1 for x in lines if x.rstrip()[-1:] in _END_SIGNS) / max(len(lines), 1),
        "guessed": lang if lang and known[lang] >= 0.1 else None,
        "word_length": min(letters / n, 20.0),
        "symbols": signs / chars,
        "digits": digits / chars,
        "common": known[lang] if lang else 0.0,
        "repeated": max(0.0, top - 0.12) + max(0.0, again - 0.35),
        "sentences": min(1.0, in_sentences / chars),
        "odd_words": odd / max(tokens, 1),
        "list_share": in_list / max(total, 1),
        "table_share": in_table / max(total, 1),
    }


_COLUMNS = ("words", "lines", "guessed", *STATS)
_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in ("words", "lines") else T.StringType() if c == "guessed" else T.DoubleType()) for c in _COLUMNS])


def measured(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, group (the language guessed from the words, else as stated, else EVERY) and the statistics of every document.

    The word list is a fixed table of frequent words; it is refused beyond 100,000 rows.
    """
    rows = common_words.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the table of common words is not a short list")
    common: dict[str, set[str]] = {}
    for r in rows:
        common.setdefault(r["lang"], set()).add(r["word"].lower())

    every = set().union(*common.values())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([statistics(t, common, every) for t in batch], columns=list(_COLUMNS))

    stated = F.when(F.col("lang").rlike("^[a-z]{2,3}$") & (F.col("lang") != "und"), F.col("lang"))
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), stated.alias("stated"), F.pandas_udf(run, _SCHEMA)("text").alias("s"))
    return out.select("doc_id", F.coalesce("s.guessed", "stated", F.lit(EVERY)).alias("group"), *[F.col(f"s.{c}").alias(c) for c in _COLUMNS if c != "guessed"])


def _contributions(batch: pd.DataFrame, model: dict) -> np.ndarray:
    """Each statistic's part of the squared distance of every row of a batch."""
    values = batch[list(STATS)].to_numpy(dtype=float)
    out = np.zeros_like(values)
    group = batch["group"].to_numpy()
    for lang in set(group):
        m = model.get(lang) or model.get(EVERY)
        if m is not None:
            rows = group == lang
            z = np.clip((values[rows] - m["centre"]) / m["scale"], -1e3, 1e3)
            out[rows] = z * (z @ m["inverse"])
    return out


def _with_contributions(stats: DataFrame, model: dict) -> DataFrame:
    """``c_<stat>``: each statistic's part of the squared distance ``distance2``; they add up to it. Vectorised per batch."""
    names = [f"c_{s}" for s in STATS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = _contributions(batch, model)
            yield pd.DataFrame(out, columns=names).assign(distance2=out.sum(axis=1))

    shape = T.StructType([T.StructField(c, T.DoubleType()) for c in (*names, "distance2")])
    scored = stats.withColumn("_c", F.pandas_udf(run, shape)(F.struct("group", *STATS)))
    return scored.select("*", "_c.*").drop("_c")


def _moments(stats: DataFrame, model: dict) -> dict[str, np.ndarray]:
    """For each language and EVERY the sums over documents near their prose: [n, sums, products] as one matrix.

    Tasks send sums per batch, which are added up per language and cell; one row per language and cell reaches the driver.
    """
    width = len(STATS) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = _contributions(batch, model).sum(axis=1) <= INLIER
            x = np.column_stack([np.ones(near.sum()), batch.loc[near, list(STATS)].to_numpy(dtype=float)])
            group = batch.loc[near, "group"].to_numpy()
            for lang in {*group, EVERY}:
                own = x if lang == EVERY else x[group == lang]
                yield pd.DataFrame({"group": lang, "cell": np.arange(width * width), "value": (own.T @ own).ravel()})

    cells = stats.select("group", *STATS).mapInPandas(run, "group string, cell int, value double").groupBy("group", "cell").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in cells.collect():
        out.setdefault(r["group"], np.zeros(width * width))[r["cell"]] = r["value"]
    return {lang: m.reshape(width, width) for lang, m in out.items()}


def fit_prose(stats: DataFrame) -> dict:
    """Robust centre, scale and inverse covariance of prose per language and over all documents (EVERY).

    A language of fewer than ``LEAST_DOCS`` documents has none of its own. One row of sums per language reaches the driver.
    """

    known = stats.withColumn("group", F.when(F.col("group") != EVERY, F.col("group")))
    middle = known.rollup("group").agg(F.count("*").alias("n"), F.grouping("group").alias("whole"), *[F.percentile_approx(s, [0.25, 0.5, 0.75], 10_000).alias(s) for s in STATS])
    model: dict = {}
    floor = [FLOOR[s] for s in STATS]
    for r in middle.where(f"whole = 1 OR group IS NOT NULL AND n >= {LEAST_DOCS}").collect():
        q = np.array([r[s] for s in STATS], dtype=float)
        model[EVERY if r["whole"] else r["group"]] = {"centre": q[:, 1], "scale": np.maximum((q[:, 2] - q[:, 0]) / 1.349, floor), "inverse": np.eye(len(STATS))}
    for _ in range(STEPS):
        for lang, sums in _moments(stats, model).items():
            n = sums[0, 0]
            if n < LEAST_DOCS:
                continue
            mean = sums[0, 1:] / n
            cov = sums[1:, 1:] / n - np.outer(mean, mean)
            scale = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), floor)
            shape = cov / np.outer(scale, scale)
            np.fill_diagonal(shape, 1.0)
            model[lang] = {"centre": mean, "scale": scale, "inverse": np.linalg.inv(shape + RIDGE * np.eye(len(STATS)))}
    return model


def judged(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Every document once with its statistics, its distance from prose, each contribution and ``form``.

    form: list or table where more than half of the characters are entries or rows, junk where the running text itself
    lies beyond OUTLIER, prose otherwise. Defined cases: a null, empty or blank text is junk; repeated rows count once;
    a table without documents gives an empty result; without any document of a language nothing is compared with it.
    """
    stats = cut(measured(documents, common_words).dropDuplicates(["doc_id"]))
    if stats.isEmpty():
        model: dict = {}
    else:
        model = fit_prose(stats)
    scored = _with_contributions(stats, model)
    text = sum((F.greatest(F.col(f"c_{s}"), F.lit(0.0)) for s in TEXT_STATS), F.lit(0.0))
    far = F.col("distance2") > OUTLIER
    form = (
        F.when(F.col("words") == 0, F.when(F.col("list_share") > 0.5, "list").when(F.col("table_share") > 0.5, "table").otherwise("junk"))
        .when(far & (F.col("list_share") > 0.5), "list")
        .when(far & (F.col("table_share") > 0.5), "table")
        .when(far & (text > OUTLIER), "junk")
        .otherwise("prose")
    )
    return scored.withColumn("text_distance2", text).withColumn("form", form)
