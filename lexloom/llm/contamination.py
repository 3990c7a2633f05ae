"""Held-out evaluation passages found in training documents.

The normalised word n-grams of the test items go into broadcast hash tables; every document's windows are scanned and
each hit is verified word by word. The windows are laid so that none can be missed: an item with at most one word in
ten edited still has a run of unchanged words of a length that follows from its own length, and every such run holds
a window that starts on the scanning grid. Items are grouped by that length, each group with a window and a grid of
its own, so a short item does not make the scan for long ones finer. Items of fewer than ten words allow no edit; they
are looked up whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 20  # so many consecutive words of an item are a leak
EDITS = 10  # one word in so many may be changed, dropped or added in a whole item
BLOCK_ITEMS = 20_000  # items in one broadcast; more items come in several
BLOCK_CHARS = 16_000_000  # and so many characters of them, which make about 2.5 million windows of 20 bytes

_WORD = re.compile(r"[^\W_]+")
_TYPED = re.compile(r"\S+")
_P = np.uint64(0x9E3779B97F4A7C15)


def fold(word: str) -> str:
    """A word without case and accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def composed(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def sure_run(length: int) -> int:
    """Words in a row that a copy of an item of ``length`` words keeps, whatever one word in ten becomes."""
    k = length // EDITS
    return max(1, min(RUN, -(-(length - k) // (k + 1))))


def typed(text: str) -> list[list[str]]:
    """The words of a text, those typed without a space between them together ("Saint-Aubrelin", "l'eau")."""
    return [own for t in _TYPED.findall(text) if (own := [fold(w) for w in _WORD.findall(t)])]


def _maximal(found: set[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that lie in no other one, in order; of equal spans the whole copy."""
    out: list[tuple[int, int, str]] = []
    for a, e, kind in sorted(found, key=lambda s: (s[0], -s[1], s[2] != "whole")):
        if not out or e > out[-1][1]:
            out.append((a, e, kind))
    return out


def _hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` word ids from each position of ``at`` on."""
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        h = (h + ids[at + j].astype(np.uint64) + np.uint64(1)) * _P
        h ^= h >> np.uint64(29)
    return h


class Table:
    """The n-grams of the items of one group, sorted by hash; scanned on every ``stride``-th window of a document."""

    def __init__(self, members: list[tuple[int, np.ndarray]], n: int, stride: int):
        self.n, self.stride = n, stride
        keys = np.concatenate([np.full(len(w) - n + 1, k, dtype=np.int64) for k, w in members])
        places = np.concatenate([np.arange(len(w) - n + 1, dtype=np.int64) for _, w in members])
        hashes = np.concatenate([_hashes(w, np.arange(len(w) - n + 1), n) for _, w in members])
        order = np.argsort(hashes, kind="stable")
        self.keys, self.places, self.hashes = keys[order], places[order], hashes[order]

    def hits(self, ids: np.ndarray, ends: np.ndarray, starts: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, position in the item) of every window on the grid that an item holds. ``starts`` and
        ``ends``: where the document of each word begins and ends; ``gaps``: words of no item up to each position."""
        at = np.arange(max(0, len(ids) - self.n + 1))
        at = at[((at - starts[at]) % self.stride == 0) & (at + self.n <= ends[at])]
        at = at[gaps[at + self.n] == gaps[at]]
        h = _hashes(ids, at, self.n)
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        row = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.keys[row], self.places[row]


class Items:
    """Test items as word ids, with a table of n-grams for each length of sure run."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.words: dict[int, list[int]] = {}
        self.typed: dict[int, list[tuple[int, ...]]] = {}
        self.run: dict[int, int] = {}
        self.raw: dict[str, int] = {}
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for key, text in items:
            tokens = [tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t) for t in typed(composed(text or ""))]
            ids = [i for t in tokens for i in t]
            if not ids:
                continue
            self.words[key], self.typed[key] = ids, tokens
            run = self.run[key] = min(sure_run(len(ids)), sure_run(len(tokens)))
            n = len(ids) if len(ids) < EDITS else (run + 2) // 2
            groups.setdefault((n, 1 if len(ids) < EDITS else run - n + 1), []).append((key, np.array(ids, dtype=np.int64)))
        self.tables = [Table(members, n, stride) for (n, stride), members in groups.items()]

    def ids(self, words: list[str]) -> list[int]:
        """Word ids; words of no item are -1."""
        raw = self.raw
        if len(raw) > 500_000:
            raw.clear()
        out = []
        for w in words:
            i = raw.get(w)
            if i is None:
                i = raw[w] = self.vocabulary.get(fold(w), -1)
            out.append(i)
        return out

    def scan(self, text: str) -> list[tuple[int, int, int, str]]:
        """(item, first word, behind the last word, kind) of every maximal span of an item in a text; kind is run or whole."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str]) -> list[list[tuple[int, int, int, str]]]:
        """``scan`` of many texts, the windows of all of them hashed at once."""
        each = [self.ids(_WORD.findall(composed(t))) for t in texts]
        sizes = np.array([len(x) for x in each], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.array([i for x in each for i in x], dtype=np.int64)
        starts, ends = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
        gaps = np.concatenate(([0], np.cumsum(ids < 0)))
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for table in self.tables:
            at, keys, places = table.hits(ids, ends, starts, gaps)
            docs = np.searchsorted(bounds, at, "right") - 1
            own = at - bounds[docs]
            for d, k, shift, i in zip(docs.tolist(), keys.tolist(), (own - places).tolist(), own.tolist(), strict=True):
                hits.setdefault(d, []).append((k, shift, i))
        return [self._leaks(t, x, hits[d]) if d in hits else [] for d, (t, x) in enumerate(zip(texts, each, strict=True))]

    def _leaks(self, text: str, ids: list[int], hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
        spans_of: dict[int, set[tuple[int, int, str]]] = {}
        tokens: list | None = None
        line, beyond, aligned = None, 0, False
        for key, shift, i in sorted(hits):
            item = self.words[key]
            if (key, shift) != line:
                line, beyond, aligned = (key, shift), 0, False
            elif i < beyond:  # inside the run just measured on this diagonal
                continue
            a = c = i
            while a > 0 and a > shift and ids[a - 1] == item[a - 1 - shift]:
                a -= 1
            while c < len(ids) and c - shift < len(item) and ids[c] == item[c - shift]:
                c += 1
            beyond = c
            if c - a >= min(RUN, len(item)):
                spans_of.setdefault(key, set()).add((a, c, "whole" if c - a == len(item) else "run"))
            if self.run[key] <= c - a < len(item) and not aligned:  # a run may be part of an edited copy of the whole item
                aligned = True
                leak = self._whole(ids, item, shift, len(item) // EDITS)
                if not leak and self._likely(ids, key, shift):
                    tokens = tokens or self._typed(text)
                    leak = self._whole_typed(tokens, key, shift)
                if leak:
                    spans_of.setdefault(key, set()).add(leak)
        return [(key, *span) for key in sorted(spans_of) for span in _maximal(spans_of[key])]

    def _likely(self, ids: list[int], key: int, shift: int) -> bool:
        """Whether enough of an item's words typed together are near a shift at all."""
        tokens = self.typed[key]
        length = len(self.words[key])
        present = set(ids[max(0, shift - length // 2) : shift + length + length // 2])
        return len(tokens) < length and sum(present.issuperset(t) for t in tokens) >= len(tokens) - len(tokens) // EDITS

    def _typed(self, text: str) -> tuple[list[tuple[int, ...]], list[int]]:
        """(words typed together, where each begins and the last ends)."""
        tokens = [tuple(self.vocabulary.get(w, -1) for w in t) for t in typed(composed(text))]
        at = [0]
        for t in tokens:
            at.append(at[-1] + len(t))
        return tokens, at

    def _whole_typed(self, tokens: tuple, key: int, shift: int) -> tuple | None:
        """The whole item where words typed together ("Saint-Aubrelin-le-Haut") are one word, changed or dropped at once."""
        words, at = tokens
        item = self.typed[key]
        near = int(np.searchsorted(at, max(shift, 0), "right")) - 1
        known: dict[tuple, int] = {}
        code = lambda t: known.setdefault(t, len(known))
        slack = len(item) // EDITS
        lo = max(0, near - 3 * slack)
        window = [code(t) for t in words[lo : near + len(item) + 3 * slack]]
        leak = self._whole(window, [code(t) for t in item], near - lo, slack)
        return leak and (at[lo + leak[0]], at[lo + leak[1]], leak[2])

    @staticmethod
    def _whole(ids: list[int], item: list[int], shift: int, slack: int) -> tuple | None:
        """The whole item with at most ``slack`` word edits near a shift: banded alignment, free ends in the document."""
        if not slack:
            return None
        lo = max(0, shift - slack)
        window = ids[lo : shift + len(item) + slack]
        present = set(window)
        if sum(w in present for w in item) < len(item) - slack:  # words missing from the window are edits each
            return None
        big = 10**6
        rows: list[tuple[int, int]] = [(0, s) for s in range(len(window) + 1)]  # cost, start
        for r, w in enumerate(item, 1):
            centre = r + shift - lo
            first, last = max(0, centre - 2 * slack), min(len(window), centre + 2 * slack)
            fresh = [(big, 0)] * (len(window) + 1)
            if first == 0:
                fresh[0] = (rows[0][0] + 1, 0)
            least = big
            for s in range(max(1, first), last + 1):
                up, left, diagonal = rows[s], fresh[s - 1], rows[s - 1]
                cell = (diagonal[0] + (window[s - 1] != w), diagonal[1])
                if up[0] + 1 < cell[0]:
                    cell = (up[0] + 1, up[1])
                if left[0] + 1 < cell[0]:
                    cell = (left[0] + 1, left[1])
                fresh[s] = cell
                least = min(least, cell[0])
            if least > slack:
                return None
            rows = fresh
        cost, end = min((c, e) for e, (c, _) in enumerate(rows))
        return (lo + rows[end][1], lo + end, "whole") if cost <= slack else None


_LEAKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("end_word", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("first_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("kind", pa.string()), ("first_char", pa.int32()), ("end_char", pa.int32())])


_books: dict[str, Items] = {}  # of this worker; one at a time, so its memory is bounded by one block


def _book(token: str, items: list[tuple[int, str]]) -> Items:
    if token not in _books:
        _books.clear()
        _books[token] = Items(items)
    return _books[token]


def _scan(documents: DataFrame, blocks: list[list[tuple[int, str]]]) -> DataFrame:
    """One scan of the documents for all blocks of items. With several blocks a task keeps its input split to go through it again."""
    spark = documents.sparkSession
    shared = [(uuid.uuid4().hex, spark.sparkContext.broadcast(b)) for b in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = batches if len(shared) == 1 else list(batches)
        for token, items in shared:
            book = _book(token, items.value)
            for batch in held:
                rows = []
                texts = batch.column(1).to_pylist()
                for doc, text, leaks in zip(batch.column(0).to_pylist(), texts, book.scan_all(texts), strict=True):
                    if leaks:
                        where = spans(composed(text))
                        rows += [(doc, k, a, e, kind, where[a][0], where[e - 1][1]) for k, a, e, kind in leaks]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

    return documents.mapInArrow(run, _LEAKS)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every leaked span: doc_id, item_id, first_word, end_word, kind, first_char, end_char (in the composed text).

    A leak is a run of at least 20 words of an item, or the whole item with at most one word in ten edited; words typed
    without a space between them may also count as one word, changed or dropped at once. An item found in several
    places of a document gives a row for each maximal span; spans of one item may overlap. Items come to the workers
    in blocks of bounded size, all of them in one scan of the documents. Defined cases: null or empty texts and items
    without words leak nothing; an item shorter than 20 words leaks as a whole only; repeated rows give the same leak
    once; empty tables give an empty result; extra columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    tests = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    size = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    blocks = [[tuple(r) for r in tests.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()] for b in range(n)]
    return _scan(docs, blocks).distinct()


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with all their leaked spans cut out: doc_id, text, n_leaks (spans of all items). Documents without a leak stay as they are."""
    cuts = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_char", "end_char"))).alias("cuts"))

    def cut_out(texts, all_cuts):
        out = []
        for text, own in zip(texts, all_cuts, strict=True):
            if text is None or own is None:
                out.append(text)
                continue
            text, at, kept = composed(text), 0, []
            for c in own:
                if c["first_char"] > at:
                    kept.append(text[at : c["first_char"]])
                at = max(at, c["end_char"])
            out.append("".join([*kept, text[at:]]))
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined = documents.select(F.col("doc_id").cast("long"), "text").join(cuts, "doc_id", "left")
    hit = joined.where("cuts IS NOT NULL").select("doc_id", F.pandas_udf(cut_out, T.StringType())("text", "cuts").alias("text"), F.size("cuts").alias("n_leaks"))
    clear = joined.where("cuts IS NULL").select("doc_id", "text", F.lit(0).alias("n_leaks"))
    return hit.unionByName(clear)
