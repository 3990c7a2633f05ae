"""Block quotes of orders: nesting, content and unbalanced quotes, and what they do to titles."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import grammar as G

_OPENING = re.compile(r'^(?:\s*")+')
_CLOSING = re.compile(G.QUOTE_END)
_STARTS = re.compile(G.QUOTE_START)


def _step(text: str) -> int:
    """What a line does to the depth of quotes; an even number of quotes does nothing."""
    return 0 if text.count('"') % 2 == 0 else bool(_STARTS.match(text)) - bool(_CLOSING.search(text))


def block_quotes(texts: list[str], taken: list[bool]) -> tuple[list[int], list[list[int]], list[bool]]:
    """(depth, lines that open the quotes a line is in, whether it opens a quote that never ends) of the lines of an order.

    ``texts`` are folded; ``taken`` marks table and list lines, which open none. A quote begins at a line that begins with
    one and ends where opened and closed ones are even; what is in it is read again for quotes of its own. The line that
    opens a quote without an end is an error, the lines behind it are read as if it were not there.
    """
    inside: list[list[int]] = [[] for _ in texts]
    wrong = [False] * len(texts)
    todo = [(0, len(texts), list(texts))]
    while todo:
        low, high, own = todo.pop()
        level = [0]  # depth behind each line of this stretch
        for text in own:
            level.append(level[-1] + _step(text))
        at: dict[int, list[int]] = defaultdict(list)
        for i, v in enumerate(level):
            at[v].append(i)
        i = 0
        while i < high - low:
            if taken[low + i] or not _STARTS.match(own[i]):
                i += 1
                continue
            bare = _OPENING.sub("", own[i])
            # the quote ends behind the first line where its own depth, one at first, is back to nothing
            if 1 + _step(bare) == 0:
                end = i + 1
            else:
                places = at[level[i + 1] - 1 - _step(bare)]
                k = bisect_left(places, i + 2)
                end = places[k] if k < len(places) else None
            if end is None:
                wrong[low + i] = True
                i += 1
                continue
            for j in range(i, end):
                inside[low + j].append(low + i)
            content = [bare, *own[i + 1 : end]]
            content[-1] = _CLOSING.sub("", content[-1], count=1)
            todo.append((low + i, low + end, content))
            i = end
    return [len(x) for x in inside], inside, wrong


def with_quotes(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """``lines`` (featured) with ``quote_depth``, ``quote_line`` (the line that opens the outermost quote) and ``unbalanced``.

    Only orders with a line that begins with a quote leave the JVM, line by line in order. Defined cases: a null text
    has no quotes; lines at one place are ordered as they come; an empty table gives an empty result.
    """
    starts = lines.where(F.col("folded").rlike(G.QUOTE_START)).select(doc).distinct()
    some = lines.join(starts, doc, "left_semi").select(doc, at, F.coalesce("folded", F.lit("")).alias("folded"), F.coalesce(F.col("block").isin("table", "list"), F.lit(False)).alias("taken"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b[doc], b[at], b["folded"], b["taken"], strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            own = list(group)
            depth, inside, wrong = block_quotes([r[2] for r in own], [r[3] for r in own])
            yield pd.DataFrame({doc: [r[0] for r in own], at: [r[1] for r in own], "quote_depth": depth, "quote_line": pd.array([own[x[0]][1] if x else None for x in inside], dtype="Int64"), "unbalanced": wrong})

    kinds = dict(lines.dtypes)
    found = some.repartition(doc).sortWithinPartitions(doc, at).mapInPandas(run, f"`{doc}` {kinds[doc]}, `{at}` {kinds[at]}, quote_depth int, quote_line long, unbalanced boolean")
    out = lines.join(found, [doc, at], "left")
    return out.withColumns({"quote_depth": F.coalesce("quote_depth", F.lit(0)), "unbalanced": F.coalesce("unbalanced", F.lit(False))})


def own_titles(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Lines with ``title`` only where a section begins: not in a block quote, and not inside a run of table or list lines.

    ``lines`` come from ``with_quotes``. A title that begins a run of its own still is one.
    """
    w = Window.partitionBy(doc).orderBy(at)
    runs_on = F.col("block").isin("table", "list") & (F.col("block") == F.lag("block").over(w)) & ~F.coalesce(F.lag("title").over(w), F.lit(False))
    return lines.withColumn("_on", F.coalesce(runs_on, F.lit(False))).withColumn("title", F.col("title") & ~F.col("_on") & (F.col("quote_depth") == 0)).drop("_on")
