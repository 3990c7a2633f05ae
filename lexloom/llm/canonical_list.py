"""Free-typed values mapped to the closest entry of a reference list, by a broadcast symmetric-delete dictionary.

The reference list is small by contract: its index is measured in keys (``MAX_KEYS``) before it is sent, and every
worker builds it once. Deletions are taken from the last ``WINDOW`` characters of a title, which is exact for bounded
edit distance and keeps the keys of a title few whatever its length. Every distinct typed value is looked up under
bounded edit distance and its candidates are ranked by weighted Damerau-Levenshtein distance, then by how often the
entry is named outright; cut-off words and initials have keys of their own. Values without an entry are reported.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.lookalikes import plain_form
from lexloom.runtime import latest, spread

MAX_EDITS = 2  # edits a typed value may be away from an entry
WINDOW = 14  # deletions are taken from so many characters at the end of a title
MAX_KEYS = 4_000_000  # deletion keys (some 80 bytes each) of a reference list; a longer list is refused, so the index stays bounded
MAX_ENTRIES = MAX_KEYS // (2 * (1 + WINDOW + WINDOW * (WINDOW - 1) // 2))  # each entry has two forms
# Words of a title that carry no meaning of their own.
STOP = {"de", "des", "du", "d", "la", "le", "les", "l", "et", "a", "au", "aux"}
# Words before a title, and remarks after it, that do not change what it means.
LEAD = {"le", "du", "de", "dudit", "ledit", "au", "audit", "cf", "voir", "vu", "selon", "dans", "par", "susdit", "meme"}
TAIL = {"precite", "susvise", "vise", "susmentionne", "modifie", "consolide", "francais"}
# Glyphs typed or read for one another; such an exchange costs less.
CONFUSED = {frozenset(p) for p in ("0o", "1l", "1i", "il", "5s", "8b", "6g", "mn", "uv", "ec", "rn", "ft", "ij", "2z", "9g")}


def fold(text: str) -> str:
    """Lower case, no accents, plain characters; everything but letters and digits is one space."""
    flat = unicodedata.normalize("NFD", plain_form(text)).lower().replace("œ", "oe").replace("æ", "ae")
    flat = "".join(c for c in flat if not unicodedata.combining(c))
    flat = regex.sub(r"[^a-z0-9]+", " ", flat)
    flat = regex.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", flat)
    return regex.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", flat).strip()


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein: swaps cost 0.8 (1.8 with a letter lost or gained between), look-alike exchanges 0.5,
    word gaps 0.6, all other edits 1."""
    gap = lambda c: 0.6 if c == " " else 1.0
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        d[i][0] = d[i - 1][0] + gap(x)
    for j, y in enumerate(b, 1):
        d[0][j] = d[0][j - 1] + gap(y)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.5 if frozenset((x, y)) in CONFUSED else 1.0
            best = min(d[i - 1][j] + gap(x), d[i][j - 1] + gap(y), d[i - 1][j - 1] + cost)
            if i > 1 and j > 1:
                if x == b[j - 2] and a[i - 2] == y:
                    best = min(best, d[i - 2][j - 2] + 0.8)
                elif i > 2 and x == b[j - 2] and a[i - 3] == y:
                    best = min(best, d[i - 3][j - 2] + 1.8)
                elif j > 2 and x == b[j - 3] and a[i - 2] == y:
                    best = min(best, d[i - 2][j - 3] + 1.8)
            d[i][j] = best
    return d[-1][-1]


def shape(flat: str) -> str:
    """A folded value with glyphs that read alike made one: "rn" as m, i and 1 as l."""
    return flat.replace("rn", "m").replace("vv", "w").replace("i", "l").replace("1", "l").replace("0", "o").replace("5", "s")


def deletes(word: str, edits: int) -> set[str]:
    """All strings left after up to ``edits`` deletions."""
    out = {word}
    for k in range(1, min(edits, len(word)) + 1):
        for gone in combinations(range(len(word)), k):
            drop = set(gone)
            out.add("".join(c for i, c in enumerate(word) if i not in drop))
    return out


def _window(form: str) -> set[str]:
    """The keys of a form: of two forms within MAX_EDITS edits the last WINDOW characters share one."""
    return deletes(form[-WINDOW:], MAX_EDITS)


class Dictionary:
    """Entries by full folded title, content words, initials, beginnings of their words, and deletions."""

    def __init__(self, entries: list[tuple[str, str]], weight: dict[str, int] | None = None):
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"the reference list has {len(entries)} entries; the bound is {MAX_ENTRIES}")
        self.weight = weight or {}
        self.full: dict[str, set[str]] = defaultdict(set)
        self.shapes: dict[str, set[str]] = defaultdict(set)
        self.words: dict[str, list[str]] = {}
        self.initials: dict[str, set[str]] = defaultdict(set)
        self.starts: dict[tuple[str, ...], list[str]] = defaultdict(list)
        self.forms: list[tuple[str, str]] = []
        self.near: dict[str, list[int]] = {}
        self.longest = 0
        for title, cid in entries:
            flat = fold(title)
            content = self.content(flat)
            self.words[cid] = content
            self.starts[tuple(w[:2] for w in content)].append(cid)
            self.initials["c" + "".join(w[0] for w in content)].add(cid)
            self.shapes[shape(flat)].add(cid)
            self.shapes[shape(" ".join(content))].add(cid)
            for form in {flat, " ".join(content)}:
                if form:
                    self.longest = max(self.longest, len(form))
                    self.full[form].add(cid)
                    for d in _window(form):
                        self.near.setdefault(d, []).append(len(self.forms))
                    self.forms.append((form, cid))

    @staticmethod
    def content(flat: str) -> list[str]:
        words = [w for w in flat.split() if w not in STOP]
        return words[1:] if words[:1] == ["code"] else words

    def pick(self, scored: list[tuple[float, str]]) -> str | None:
        """The nearest entry; of equally near ones the one named more often; none if that ties too."""
        best: dict[str, float] = {}
        for s, cid in scored:
            best[cid] = min(s, best.get(cid, 9e9))
        order = sorted((s, -self.weight.get(cid, 0), cid) for cid, s in best.items())
        if not order:
            return None
        if len(order) > 1 and order[0][:2] == order[1][:2]:
            return None
        return order[0][2]

    def exact(self, flat: str) -> str | None:
        short = " ".join(self.content(flat))
        hit = self.full.get(flat) or self.full.get(short) or self.shapes.get(shape(flat)) or self.shapes.get(shape(short))
        return next(iter(hit)) if hit and len(hit) == 1 else None

    def fuzzy(self, flat: str) -> str | None:
        """Bounded edit distance through common deletions, on the full form, else on the content words."""
        for form in dict.fromkeys((flat, " ".join(self.content(flat)))):
            if not 4 <= len(form) <= self.longest + MAX_EDITS:  # no entry is within reach
                continue
            seen = {self.forms[i] for d in _window(form) for i in self.near.get(d, ())}
            scored = [(weighted_distance(form, entry), cid) for entry, cid in seen if abs(len(entry) - len(form)) <= MAX_EDITS]
            limit = MAX_EDITS if len(form) > 7 else 1
            if cid := self.pick([(s, c) for s, c in scored if s <= limit]):
                return cid
        return None

    def abbreviated(self, raw: str, flat: str) -> str | None:
        """Content words cut short, in order ("C. riv. étang."), or the initials of one title alone ("C.R.M.")."""
        words = flat.split()
        if not words:
            return None
        letters = "".join(words)
        if all(len(w) == 1 for w in words) or len(words) == 1 and regex.fullmatch(r"\s*[A-ZÀ-Þ](?:\.?\s*[A-ZÀ-Þ])+\.?\s*", plain_form(raw)):
            hit = self.initials.get(letters, set())
            return next(iter(hit)) if len(hit) == 1 else None
        if words[0] in ("c", "co", "cod", "code"):
            words = words[1:]
        words = [w for w in words if w not in STOP]
        hits = [
            cid for cid in self.starts.get(tuple(w[:2] for w in words), ())
            if all(len(w) >= 2 and c.startswith(w) for w, c in zip(words, self.words[cid], strict=True))
        ]
        return hits[0] if len(hits) == 1 else None

    def lookup(self, raw: str | None) -> str | None:
        """The entry a typed value means, or None."""
        for flat in _readings(raw or ""):
            if cid := self.exact(flat):
                return cid
        for flat in _readings(raw or ""):
            if cid := self.fuzzy(flat) or self.abbreviated(raw or "", flat):
                return cid
        return None


def _readings(raw: str) -> list[str]:
    """The value as it stands, then without remarks around it."""
    out = [fold(raw)]
    if m := regex.match(r"^(.*\S)\s*\(\s*(c[o0]de[^()]*)\)\s*$", raw, regex.I):
        out.append(fold(f"{m[2]} {m[1]}"))
    bare = regex.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", raw)
    for text in (bare, regex.split(r"\s[-–—]\s|[,;:]\s", bare)[0]):
        words = fold(text).split()
        while words and words[-1] in TAIL:
            words.pop()
        while len(words) > 1 and words[0] in LEAD:
            words.pop(0)
        out.append(" ".join(words))
    return [x for x in dict.fromkeys(out) if x]


# The parts of a typed article number.
_REMARK = regex.compile(r"\b(?:al(?:inea)?s?|par(?:agraphe)?|et\s+suivants?|ets|modifiee?|du\s+code)\b.*$")


def article_number(raw: str | None) -> str | None:
    """The number in the catalogue's form (letter, then groups with hyphens), or None if nothing in it is a number."""
    if raw is None:
        return None
    text = unicodedata.normalize("NFD", plain_form(raw))
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = regex.sub(r"(?<=[\d-])[lI|](?=[\d-]|\b)|(?<=\d)[lI|]|(?<=[A-Za-z])[lI|](?=\d)", "1", text)
    text = regex.sub(r"(?<=\d)[oO]|[oO](?=\d)", "0", text)
    text = regex.sub(r"(?<=\d)[sS](?=[\d\s.–-]|$)|\b[sS](?=\d)|(?<=[LRDlrd])[sS](?=\d)", "5", text).lower()
    behind = regex.search(r"\(\s*([lrda])\s*\.?\s*\)", text)
    text = regex.sub(r"\([^()]*\)", " ", text)
    text = _REMARK.sub(" ", regex.sub(r"^\W*(?:art(?:icles?)?)\b\W*", "", text))
    m = regex.search(r"(?:\b([lrda])\W*)?(\d+(?:\s*[-–—.\s]\s*\d+)*)", text)
    if not m:
        return None
    letter = m[1] or (behind[1] if behind else "")
    return letter.upper() + "-".join(regex.findall(r"\d+", m[2]))


_MAPPED = T.StringType()


_books: dict[str, Dictionary] = {}  # of this worker; one at a time


def _book(token: str, entries: list[tuple[str, str]], weight: dict[str, int]) -> Dictionary:
    if token not in _books:
        _books.clear()
        _books[token] = Dictionary(entries, weight)
    return _books[token]


def map_values(values: DataFrame, col: str, entries: list[tuple[str, str]], weight: dict[str, int] | None = None) -> DataFrame:
    """(value, entry) for each distinct value of ``col``; ``entry`` is null where no entry is meant."""
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"the reference list has {len(entries)} entries; the bound is {MAX_ENTRIES}")
    shared, token = values.sparkSession.sparkContext.broadcast((entries, weight or {})), uuid.uuid4().hex

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        book = _book(token, *shared.value)
        for batch in batches:
            yield batch.map(book.lookup, na_action="ignore").astype(object)

    return spread(values.select(F.col(f"`{col}`").alias("value")).distinct(), "value").withColumn("entry", F.pandas_udf(look, _MAPPED)("value"))


def frequencies(values: DataFrame, col: str, entries: list[tuple[str, str]]) -> dict[str, int]:
    """How often each entry is named outright, by folded equality; at most one count per entry reaches the driver."""
    folded = F.lower(F.trim(F.col(f"`{col}`")))
    names = values.sparkSession.createDataFrame([(t.strip().lower(), c) for t, c in entries], "name string, cid string")
    hits = values.select(folded.alias("name")).groupBy("name").count().join(F.broadcast(names), "name")
    return {r["cid"]: r["n"] for r in hits.groupBy("cid").agg(F.sum("count").alias("n")).collect()}


def map_mentions(mentions: DataFrame, codes: DataFrame, articles: DataFrame) -> DataFrame:
    """Every mention once with the code and the article it means; null where it means none.

    Columns: mention_id, code_cid, article_id. Defined cases: a null or blank title means no code, and then no
    article; a null number means no article; deliveries of one mention count once (the last); an empty table gives an
    empty result; extra columns are ignored whatever their names.
    """
    entries = [(r["titre"], r["cid"]) for r in codes.select("titre", "cid").where("titre is not null").limit(MAX_ENTRIES + 1).collect()]
    rows = latest(mentions.select("mention_id", "titre_raw", "num_raw", "entered_at"), ["mention_id"], "entered_at")
    found = map_values(rows, "titre_raw", entries, frequencies(rows, "titre_raw", entries))
    numbers = spread(rows.select("num_raw").distinct(), "num_raw").withColumn("num", F.pandas_udf(_numbers, T.StringType())("num_raw"))
    nums = articles.select(F.col("code_cid"), F.col("num"), F.col("id").alias("article_id")).groupBy("code_cid", "num").agg(F.min("article_id").alias("article_id"))
    return (
        rows.join(found.withColumnRenamed("value", "titre_raw").withColumnRenamed("entry", "code_cid"), "titre_raw", "left")
        .join(numbers, "num_raw", "left")
        .join(nums, ["code_cid", "num"], "left")
        .select("mention_id", "code_cid", "article_id")
    )


def _numbers(raw: pd.Series) -> pd.Series:
    return raw.map(article_number, na_action="ignore").astype(object)
