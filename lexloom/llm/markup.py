"""Markup residue in the lines of documents: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

Each line is parsed into a small DOM whose inner nodes are pieces of notation and whose leaves are text. Wrapper
induction then works on these trees: the distinct shapes of a host's lines are merged into one wrapper, each aligned
with what the others have built by simple tree matching, so shapes that differ in some nodes still share the rest.
Nodes on which at least ``LEAST`` lines agree are constant and make the template; the text slots under them vary and are
the content. A line holds notation if it has a template node; its clean form is read off the slots. Nodes that no line
of the host shares are compared with the counts of their label paths over all hosts. Headings, lists, tables, code
blocks and formulas keep a mark of their own.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators.ordered import running_total
from lexloom.runtime import cut

LEAST = 2  # lines that have to agree on a node before it is template
CHUNK = 2_000  # shapes of a host that are merged in one task; more are merged in several wrappers

# A cheap test the JVM runs on every line: without one of these characters there is no notation.
MAYBE = r"[<>#*_`~|\\\[\]{}$^&=!%]|''|^\s*[:;+>]|--|^\s*-{3}|^\s{4}|\t"

# The notation of inline markup, in order of precedence.
_INLINE = regex.compile(
    r"""
      (?P<path>\b[A-Za-z]:\\[\w.\\~-]+|(?<!\S)\\\\[\w.-]+\\[\w.\\-]+)
    | (?P<comment><!--.*?-->|<!--|-->)
    | (?P<ref><ref[^<>]*/>|<ref[^<>]*>.*?</ref\s*>)
    | (?P<tag></?[A-Za-z][A-Za-z0-9:]*(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*\s*/?>|<!DOCTYPE[^>]*>|<!\[CDATA\[|\]\]>)
    | (?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,30}|\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6});)
    | (?P<image>!\[[^\]]*\]\([^()\s]*(?:\s+"[^"]*")?\))
    | (?P<footnote>\[\^[^\]\s]+\]:?)
    | (?P<link>(?<!!)\[(?P<linktext>[^\[\]]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+"[^"]*")?\)|\[(?P<reftext>[^\[\]]+)\]\[[^\[\]]*\])
    | (?P<extlink>\[(?:https?|ftp|mailto)://?[^\s\]]+(?:\s+(?P<exttext>[^\]]*))?\])
    | (?P<category>\[\[\s*(?:Cat[ée]gorie|Category|Fichier|File|Image|Kategorie|Datei)\s*:[^\[\]]*\]\])
    | (?P<wikilink>\[\[(?:[^\[\]|]*\|)?(?P<wikitext>[^\[\]|]*)\]\])
    | (?P<wikiopen>\[\[(?:[^\[\]|\s]+\|)?|\]\])
    | (?P<template>\{\{[^{}]*\}\}|\{\{|\}\})
    | (?P<magic>(?<!\w)__(?:NO)?(?:TOC|INDEX|EDITSECTION|FORCETOC)__)
    | (?P<math>\$\$(?:[^$]|\\\$)+\$\$|(?<!\\)\$(?![\s$])(?:[^$\\]|\\.)*(?<![\s\\])\$|\\\((?:.*?)\\\)|\\\[(?:.+?)\\\])
    | (?P<mathopen>\$\$|\\[()\[\]](?!\w))
    | (?P<env>\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?(?:\{[lcrp|.@\d\s]*\})?)
    | (?P<drop>\(?\\(?:footnote|footnotemark|label|cite|ref|eqref|pageref|index|vspace|hspace|includegraphics|input|include)\*?(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}(?:(?<=\(\\(?:ref|cite|eqref|pageref)\{[^{}()]*\})\))?)
    | (?P<accent>\\['`^"~=.]\s*(?:\{\\?[A-Za-z]\}|\\?[A-Za-z])|\\[cvuHkrb]\{[A-Za-z]\})
    | (?P<rowend>\\\\(?:\[[^\]]*\])?(?=\s|$|\\))
    | (?P<command>\\[A-Za-z]+\*?(?:\[[^\]]*\])?)
    | (?P<escape>\\[%&_\#${}~^*`\[\]()!|<>+.-])
    | (?P<script>(?<=\S)[_^]\{[^{}]*\})
    | (?P<code>(?P<ticks>`+)(?!`).+?(?<!`)(?P=ticks)(?!`)|`+)
    | (?P<wikiquote>'{5}|'{2,3})
    | (?P<strong>\*\*\*|\*\*|(?<!\w)__(?=\S)|(?<=\S)__(?!\w)|~~)
    | (?P<em>(?<![\w*(])\*(?=[^\s*)])(?:[^*]*?[^\s*(])\*(?![\w*])|(?<!\w)_(?=[^\s_])(?:[^_]*?[^\s_])_(?!\w))
    | (?P<emopen>(?<![\w*(\d])\*(?=[^\W\d_])|(?<=[\w.,;»])\*(?=[\s.,;:)]|$))
    | (?P<cells>\|\||!!(?=\s)|(?<=\S)~(?=\S))
    """,
    regex.X | regex.V0,
)
_FENCE = regex.compile(r"^\s*(?:`{3,}|~{3,})\s*[\w+-]*\s*$")
_PRE = regex.compile(r"^\s*(?:<pre\b[^>]*>|<code\b[^>]*>|<source\b[^>]*>|<syntaxhighlight\b[^>]*>|\\begin\{(?:verbatim|lstlisting|minted)\})", regex.I)
_PRE_END = regex.compile(r"(?:</pre>|</code>|</source>|</syntaxhighlight>|\\end\{(?:verbatim|lstlisting|minted)\})", regex.I)
_MD_HEAD = regex.compile(r"^\s{0,3}(?P<mark>#{1,6})\s+(?P<rest>\S.*?)\s*#*\s*$")
_WIKI_HEAD = regex.compile(r"^\s*(?P<mark>={2,6})(?!=)\s*(?P<rest>.+?)\s*(?P=mark)\s*$")
_TEX_HEAD = regex.compile(r"^\s*\\(?P<mark>part|chapter|section|subsection|subsubsection|paragraph)\*?\{(?P<rest>.*)\}\s*$")
_HTML_HEAD = regex.compile(r"^\s*<h(?P<mark>[1-6])\b[^>]*>(?P<rest>.*?)(?:</h[1-6]>)?\s*$", regex.I)
_SETEXT = regex.compile(r"^\s*(?:={3,}|-{4,}|\*{3,}|_{3,})\s*$")
_MD_ROW = regex.compile(r"^\s*\|.*\|\s*$")
_MD_RULE = regex.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|\s*:?-{1,}:?\s*\|\s*$")
_WIKI_TABLE = regex.compile(r"^\s*(?:\{\|.*|\|\}|\|-+.*|\|\+.*)$")
_WIKI_ROW = regex.compile(r"^\s*[|!](?!\[)\s*\S.*$")
_QUOTE = regex.compile(r"^\s{0,3}>+\s+(?=[^\W\d_]|[>«\"])")
_STAR_BULLET = regex.compile(r"^\s*(?:\*+|\++|#{1,6}|:+|;(?=\s*\S))\s+(?=\S)")
_LIST_TAG = regex.compile(r"^\s*(?:<li\b[^>]*>|\\item\b)", regex.I)
_ROW_TAG = regex.compile(r"^\s*<t[rdh]\b", regex.I)
_PLAIN_BULLET = regex.compile(r"^\s*[-–—•]\s+\S")
_FORMULA = regex.compile(r"\\(?:frac|sqrt|times|sum|int|cdot|leq|geq|alpha|beta|left|right)\b|[_^]\{")
# The depth of a LaTeX heading, and names of its operators in plain text.
_DEPTH = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_TEX_NAMES = {
    "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "times": "×", "cdot": "·", "pm": "±", "circ": "°", "degre": "°",
    "og": "« ", "fg": " »", "ldots": "...", "dots": "...", "euro": "€", "oe": "œ", "ae": "æ", "no": "n°", "S": "§",
    "mu": "µ", "alpha": "α", "beta": "β", "lambda": "λ", "Delta": "Δ", "Omega": "Ω", "eta": "η", "quad": " ", "qquad": " ",
}
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327"}

Node = tuple  # (label, children) for notation, ("#", text) for text


def _accented(token: str) -> str:
    mark, letter = token[1], regex.sub(r"[^A-Za-z]", "", token[2:])
    return unicodedata.normalize("NFC", letter + _ACCENTS.get(mark, ""))


def _untex(text: str) -> str:
    """LaTeX of a formula to readable text: names to signs, fractions and scripts to a linear form."""
    for _ in range(4):
        text = regex.sub(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)", text)
        text = regex.sub(r"\\sqrt\s*\{([^{}]*)\}", r"√(\1)", text)
        text = regex.sub(r"\\(?:mathrm|mathbf|mathit|text|textrm|operatorname|left|right)\s*\{([^{}]*)\}", r"\1", text)
    text = regex.sub(r"\\[,;:! ]", " ", text)
    text = regex.sub(r"\\([A-Za-z]+)", lambda m: _TEX_NAMES.get(m[1], m[1] if len(m[1]) > 2 else ""), text)
    text = regex.sub(r"([_^])\{([^{}]*)\}", r"\1\2", text)
    return regex.sub(r"\s+", " ", text.replace("\\", "").replace("{", "").replace("}", "").replace("$", "")).strip()


def inline(text: str) -> list[Node]:
    """Notation and text of one line in order; the text of links, emphasis and formulas is a child of their node."""
    out: list[Node] = []
    at = 0

    def say(part: str) -> None:
        if part:
            out.append(("#", part))

    for m in _INLINE.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind in ("linktext", "reftext", "exttext", "wikitext", "ticks"):
            kind = next(k for k in ("link", "extlink", "wikilink", "code") if m.group(k) is not None)
        if kind == "path":
            continue
        say(text[at : m.start()])
        at = m.end()
        if kind in ("link", "extlink", "wikilink"):
            inner = next((m.group(g) for g in ("linktext", "reftext", "exttext", "wikitext") if m.group(g) is not None), "")
            out.append((kind, inline(inner) if inner else []))
        elif kind == "em":
            out.append((kind, inline(token[1:-1])))
        elif kind == "code":
            body = token.strip("`")
            out.append((kind, [("#", body)] if body else []))
        elif kind == "math":
            out.append((kind, [("#", _untex(regex.sub(r"^(?:\$+|\\[(\[])|(?:\$+|\\[)\]])$", "", token)))]))
        elif kind == "entity":
            out.append((kind, [("#", html.unescape(token).replace("\u00a0", " "))]))
        elif kind == "accent":
            out.append((kind, [("#", _accented(token))]))
        elif kind == "escape":
            out.append((kind, [("#", token[1:])]))
        elif kind == "script":
            out.append((kind, [("#", token[0] + token[2:-1])]))
        elif kind == "tag":
            name = regex.match(r"</?\s*([A-Za-z0-9:!]+)", token)
            out.append((f"tag:{name[1].lower() if name else '!'}", [("#", " ")] if name and name[1].lower() in ("br", "td", "th") else []))
        elif kind == "command":
            name = regex.match(r"\\([A-Za-z]+)", token)[1]
            out.append((f"tex:{name}", [("#", _TEX_NAMES[name])] if name in _TEX_NAMES else []))
        elif kind == "template":
            out.append((kind, [("#", " ".join(token.strip("{}").split("|")[1:]))] if "|" in token else []))
        elif kind == "cells" and token == "~":
            out.append((kind, [("#", " ")]))
        else:
            out.append((kind, []))
    say(text[at:])
    return out


def _cells(text: str, pattern: str) -> list[Node]:
    return [("cell", inline(part.strip())) for part in regex.split(pattern, text)]


def parse(text: str, code: bool = False) -> Node:
    """The DOM of one line: a block node whose children are inline nodes. ``code`` lines are taken as they stand."""
    if _FENCE.match(text):
        return ("fence", [])
    if code:
        return ("codeline", [("#", text)])
    if _PRE.match(text) or _PRE_END.search(text):
        return ("fence", inline(text))
    for form, label in ((_MD_HEAD, "md"), (_WIKI_HEAD, "wiki"), (_TEX_HEAD, "tex"), (_HTML_HEAD, "html")):
        if m := form.match(text):
            mark = m["mark"]
            depth = _DEPTH.get(mark) or (int(mark) if mark.isdigit() else len(mark))
            return (f"heading:{label}:{depth}", inline(m["rest"]))
    if _SETEXT.match(text):
        return ("rule", [])
    if _MD_RULE.match(text):
        return ("tablerule", [])
    if _WIKI_TABLE.match(text):
        return ("tablemark", [])
    if _MD_ROW.match(text):
        return ("row:md", _cells(text.strip().strip("|"), r"\|"))
    if _WIKI_ROW.match(text):
        return ("row:wiki", _cells(text.strip().lstrip("|!"), r"\|\||!!"))
    if regex.search(r"&.*\\\\|\\\\\s*\\hline\s*$", text):
        return ("row:tex", _cells(regex.sub(r"\\\\.*$", "", text), r"(?<!\\)&"))
    if _QUOTE.match(text):
        return ("quote", inline(_QUOTE.sub("", text)))
    children = inline(text)
    if children and all(c[0] == "env" for c in children):
        return ("block", children)
    if _LIST_TAG.match(text):
        return ("item", children)
    if _ROW_TAG.match(text):
        return ("row:html", children)
    if _STAR_BULLET.match(text) and not regex.match(r"^\s*;\s*$", text):
        return ("item:mark", inline(_STAR_BULLET.sub("", text)))
    return ("line", children)


def notation(tree: Node) -> list[str]:
    """Labels of all notation nodes of a line."""
    label, children = tree
    if label == "#":
        return []
    own = [] if label in ("line", "codeline", "cell") else [label]
    return own + [x for c in children for x in notation(c)]


def text_of(tree: Node) -> str:
    """The content of a tree: its text leaves in order."""
    label, children = tree
    if label == "#":
        return children
    return "".join(text_of(c) for c in children)


def skeleton(tree: Node) -> str:
    """The tree without its text: the wrapper's shape. Runs of alike children count once, so it stays short."""
    label, children = tree
    if label == "#":
        return "#"
    inner: list[str] = []
    for c in children:
        s = skeleton(c)
        if not inner or inner[-1] != s:
            inner.append(s)
    return f"{label}({','.join(inner)})" if inner else label


class Slot:
    """A node of a wrapper: label, how many lines agree on it, and children in order."""

    __slots__ = ("label", "children", "lines")

    def __init__(self, label: str, lines: int):
        self.label, self.lines, self.children = label, lines, []


def _kids(tree: Node) -> list[Node]:
    return [] if tree[0] == "#" else list(tree[1])


def _align(wrapper: Slot, tree: Node) -> list[tuple[Slot | None, Node]]:
    """The children of a tree with the wrapper's they correspond to, by simple tree matching."""
    ws, ts = wrapper.children, _kids(tree)
    score = [[0] * (len(ts) + 1) for _ in range(len(ws) + 1)]
    each = [[_match(w, t) for t in ts] for w in ws]
    for i in range(1, len(ws) + 1):
        for j in range(1, len(ts) + 1):
            score[i][j] = max(score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + each[i - 1][j - 1])
    i, j = len(ws), len(ts)
    out: list[tuple[Slot | None, Node]] = []
    while j:
        if i and each[i - 1][j - 1] and score[i][j] == score[i - 1][j - 1] + each[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((ws[i], ts[j]))
        elif i and score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
            out.append((None, ts[j]))
    return out[::-1]


def _match(w: Slot, t: Node) -> int:
    """Nodes of the largest common top-down, order-keeping mapping of a wrapper's node and a tree."""
    if w.label != t[0]:
        return 0
    ts = _kids(t)
    before = [0] * (len(ts) + 1)
    for x in w.children:
        row = [0]
        for j, y in enumerate(ts):
            row.append(max(before[j + 1], row[j], before[j] + _match(x, y)))
        before = row
    return before[-1] + 1


def merge(wrapper: Slot, tree: Node, lines: int) -> None:
    """Take a tree that ``lines`` lines have into a wrapper with the same root: aligned nodes gain lines, others are added."""
    at = 0
    for slot, child in _align(wrapper, tree):
        if slot is None:
            slot = Slot(child[0], 0)
            wrapper.children.insert(at, slot)
        slot.lines += lines
        merge(slot, child, lines)
        at = wrapper.children.index(slot) + 1


def agreed(wrapper: Slot, tree: Node) -> tuple[int, int]:
    """(notation nodes of a tree on which LEAST lines or more agree, all its nodes of which they do)."""
    own = wrapper.lines >= LEAST
    notes, nodes = int(own and tree[0] not in _PLAIN_NODES), int(own)
    for slot, child in _align(wrapper, tree):
        if slot is not None:
            a, b = agreed(slot, child)
            notes, nodes = notes + a, nodes + b
    return notes, nodes


def paths(tree: Node, above: str = "") -> list[str]:
    """The label paths of all notation nodes of a tree."""
    label, children = tree
    if label == "#":
        return []
    here = f"{above}/{label}"
    return ([] if label in _PLAIN_NODES else [here]) + [p for c in children for p in paths(c, here)]


_PLAIN_NODES = ("#", "line", "codeline", "cell")


def clean(tree: Node) -> tuple[str, str, int]:
    """(kind, clean text, level) of a line: notation gone, structure kept."""
    label, children = tree
    head = label.split(":")
    text = regex.sub(r"[ \t]+", " ", text_of(tree).replace("{", "").replace("}", "") if "tex:" in str(tree) else text_of(tree)).strip()
    if head[0] == "heading":
        return "heading", text, int(head[2])
    if label == "codeline":
        return "code", children[0][1] if children else "", 0
    if label == "fence":
        return "code_mark", text, 0
    if head[0] == "row":
        cells = [text_of(c).strip() for c in children if c[0] == "cell"] or [t for t in regex.split(r"\s{2,}", text_of(tree).strip()) if t]
        return "table", " | ".join(regex.sub(r"\s+", " ", c) for c in cells), 0
    if label in ("tablerule", "tablemark", "rule", "block"):
        return "mark", "", 0
    if head[0] == "item":
        return "list", "- " + text.lstrip("-* "), 1
    flat = notation(tree)
    if flat and not text:
        return "mark", "", 0
    if any(x == "script" or x.startswith("tex:") and x[4:] in ("frac", "sqrt", "times", "sum", "int", "cdot") for x in flat):
        return "formula", _untex(_source(tree)), 0
    if _PLAIN_BULLET.match(text):
        return "list", text, 1
    return "text", text, 0


def _source(tree: Node) -> str:
    """Text of a formula line with its commands put back."""
    label, children = tree
    if label == "#":
        return children
    lead = "\\" + label[4:] if label.startswith("tex:") and label[4:] not in _TEX_NAMES else ""
    return lead + "".join(_source(c) for c in children)


_PARSED = T.StructType(
    [
        T.StructField("notation", T.ArrayType(T.StringType())),
        T.StructField("skeleton", T.StringType()),
        T.StructField("slots", T.ArrayType(T.StringType())),
        T.StructField("kind", T.StringType()),
        T.StructField("clean", T.StringType()),
        T.StructField("level", T.IntegerType()),
    ]
)


def _slots(tree: Node) -> list[str]:
    label, children = tree
    return [children] if label == "#" else [s for c in children for s in _slots(c)]


def _parse_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, codes in batches:
        rows = []
        for text, code in zip(texts, codes, strict=True):
            if text is None:
                rows.append(([], None, [], None, None, 0))
                continue
            tree = parse(text, bool(code))
            rows.append((notation(tree), skeleton(tree), _slots(tree), *clean(tree)))
        yield pd.DataFrame(rows, columns=[f.name for f in _PARSED.fields])


def parsed(text: Column, code: Column) -> Column:
    """Struct of the parsed line; Arrow-batched, for lines the JVM test has let through."""
    return F.pandas_udf(_parse_batches, _PARSED)(text, code)


def maybe(text: Column) -> Column:
    """Whether a line can hold notation at all; runs in the JVM."""
    return F.coalesce(text.rlike(MAYBE), F.lit(False))


def induced(trees: DataFrame) -> DataFrame:
    """Wrapper induction: (host, skeleton, lines, template, alignment) of each shape of a host.

    ``trees``: host, skeleton. ``template`` counts the notation nodes of a shape that are constant, ``alignment`` is
    the share of all its nodes on which at least LEAST lines of the host agree. Lines are pre-aggregated to shapes, and
    shapes of one host beyond CHUNK go into several wrappers, so no task holds the lines of a host.
    """
    shapes = trees.groupBy("host", "skeleton").agg(F.count("*").alias("lines"))
    shapes = cut(shapes.withColumn("block", F.regexp_extract("skeleton", r"^([^(]*)", 1)))
    sizes = shapes.groupBy("host", "block").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    rows = shapes.withColumn("host_key", F.coalesce("host", F.lit(""))).join(sizes.withColumn("host_key", F.coalesce("host", F.lit(""))).drop("host"), ["host_key", "block"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("skeleton"), "chunks"))

    def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = (r for batch in batches for r in zip(batch["host_key"], batch["block"], batch["chunk"], batch["host"], batch["skeleton"], batch["lines"], strict=True))
        for _, group in groupby(shapes, key=lambda r: r[:3]):
            rows = [(host, skeleton, n, _tree(skeleton)) for _, _, _, host, skeleton, n in group]
            wrapper = Slot(rows[0][3][0], sum(r[2] for r in rows))
            for _, _, n, tree in rows:
                merge(wrapper, tree, n)
            out = []
            for host, skeleton, n, tree in rows:
                notes, nodes = agreed(wrapper, tree)
                out.append((host, skeleton, n, notes, nodes / _nodes(tree), paths(tree)))
            yield pd.DataFrame(out, columns=["host", "skeleton", "lines", "template", "alignment", "paths"])

    place = ["host_key", "block", "chunk"]
    spread = rows.repartition(*place).sortWithinPartitions(*place, F.desc("lines"), "skeleton")
    own = cut(spread.mapInPandas(induce, "host string, skeleton string, lines long, template int, alignment double, paths array<string>"))
    everywhere = own.select("lines", F.explode(F.array_distinct("paths")).alias("path")).groupBy("path").agg(F.sum("lines").alias("n")).where(F.col("n") >= LEAST)
    alone = own.where("template = 0").select("host", "skeleton", F.explode("paths").alias("path")).join(everywhere, "path").groupBy("host", "skeleton").agg(F.count("*").cast("int").alias("shared"))
    alone = alone.withColumnsRenamed({"host": "_host", "skeleton": "_skeleton"})
    same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("skeleton") == F.col("_skeleton"))
    return own.join(alone, same, "left").select("host", "skeleton", "lines", F.when(F.col("template") > 0, F.col("template")).otherwise(F.coalesce("shared", F.lit(0))).alias("template"), "alignment")


def notation_lines(df: DataFrame, keys: list[str], text: str, host: str) -> DataFrame:
    """Keys of the lines that hold at least one piece of notation, each once: those with a template node of the wrapper
    of their ``host``.

    Defined cases: null, empty and blank lines hold none; a piece of notation of a kind that no other line of any host
    has is no template and does not count; a null host is a host of its own; repeated rows count once, and do not
    confirm one another; whole lines of any length are parsed; extra columns are ignored whatever their names; an empty
    table gives an empty result.
    """
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{host}`").cast("string").alias("_host"), F.col(f"`{text}`").alias("_text")).where(maybe(F.col("_text"))).distinct()
    parsed_rows = rows.withColumn("_p", parsed(F.col("_text"), F.lit(False))).where(F.size("_p.notation") > 0)
    trees = cut(parsed_rows.select(*[f"`{k}`" for k in keys], "_host", F.col("_p.skeleton").alias("_skeleton")))
    template = induced(trees.select(F.col("_host").alias("host"), F.col("_skeleton").alias("skeleton"))).where("template > 0")
    same = F.col("_host").eqNullSafe(F.col("host")) & (F.col("_skeleton") == F.col("skeleton"))
    return trees.join(template.select("host", "skeleton"), same, "left_semi").select(*[f"`{k}`" for k in keys]).distinct()


def clean_lines(df: DataFrame, key: str, doc: str, order: str, text: str, host: str) -> DataFrame:
    """One row per line of each document: ``kind`` (heading, list, table, code, code_mark, formula, mark, text),
    ``level`` of a heading, ``clean`` text and the labels of the ``notation`` removed.

    Text is read off the slots of the wrapper of the line's ``host``; a line none of whose nodes is template stays as
    it is. Lines between fences are code and stay as they are. The fence state is a two-level running count, so a document
    of any length never sits in one task. Defined cases: a null line has kind null and clean null; an unclosed fence
    runs to the end of its document; repeated rows (same key, document, order and text) give one row.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{doc}`").alias("doc"), F.col(f"`{order}`").alias("at"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").cast("string").alias("host")).distinct()
    opens = F.coalesce(F.col("text").rlike(r"^\s*(?:`{3,}|~{3,})\s*[\w+-]*\s*$|^\s*<(?:pre|code|source)\b|</(?:pre|code|source)>|\\\\(?:begin|end)\{(?:verbatim|lstlisting)\}"), F.lit(False))
    one_line = F.coalesce(F.col("text").rlike(r"<(pre|code|source)\b.*</\1>"), F.lit(False))
    rows = rows.withColumn("fence", (opens & ~one_line).cast("long"))
    rows = running_total(rows, ["doc"], ["at", "key"], "fence", "fences")
    inside = (F.col("fence") == 0) & (F.col("fences") % 2 == 1)
    looked = rows.withColumn("inside", inside).withColumn("look", maybe(F.col("text")) | F.col("inside"))
    need = cut(looked.where("look").withColumn("p", parsed(F.col("text"), F.col("inside"))).select("key", "doc", "at", "text", "host", "p.*"))
    noted = F.size("notation") > 0
    template = induced(need.where(noted).select("host", "skeleton")).where("template > 0").select(F.col("host").alias("_host"), F.col("skeleton").alias("_skeleton"))
    joined = need.where(noted).join(template, F.col("host").eqNullSafe(F.col("_host")) & (F.col("skeleton") == F.col("_skeleton")), "left")
    unknown = F.col("_skeleton").isNull()
    done = joined.select(
        "key", "doc", "at", F.when(unknown, "text").otherwise(F.col("kind")).alias("kind"), F.when(unknown, 0).otherwise(F.col("level")).alias("level"),
        F.when(unknown, F.trim("text")).otherwise(F.col("clean")).alias("clean"), F.when(unknown, F.array().cast("array<string>")).otherwise(F.col("notation")).alias("notation"),
    ).unionByName(need.where(~noted).select("key", "doc", "at", "kind", "level", "clean", "notation"))
    bullet = F.col("text").rlike(r"^\s*[-–—•]\s+\S")
    rest = looked.where("not look").select(
        "key", "doc", "at",
        F.when(F.col("text").isNotNull(), F.when(bullet, "list").otherwise("text")).alias("kind"),
        F.when(bullet, 1).otherwise(0).alias("level"),
        F.trim("text").alias("clean"),
        F.array().cast("array<string>").alias("notation"),
    )
    return done.unionByName(rest).withColumnsRenamed({"key": key, "doc": doc, "at": order})


def wrappers(df: DataFrame, host: str, text: str) -> DataFrame:
    """Induced wrappers: for each host and shape of line how many lines it has, how many of its slots vary (content) or
    stay constant over at least three lines (template), how many of its notation nodes are template, and its alignment.

    All statistics are combinable aggregates, so a host of any size is never gathered in one task.
    """
    lines = df.select(F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").alias("text")).where(maybe(F.col("text")))
    trees = cut(lines.withColumn("p", parsed(F.col("text"), F.lit(False))).where(F.size("p.notation") > 0).select("host", "p.skeleton", "p.slots"))
    slots = trees.select("host", "skeleton", F.posexplode("slots").alias("pos", "slot")).groupBy("host", "skeleton", "pos").agg(
        F.count("*").alias("n"), (F.min("slot") == F.max("slot")).alias("same")
    )
    fixed = F.col("same") & (F.col("n") >= 3)
    slots = slots.groupBy(F.col("host").alias("_host"), F.col("skeleton").alias("_skeleton")).agg(F.count_if(fixed).alias("template_slots"), F.count_if(~fixed).alias("content_slots"))
    zero = F.lit(0).cast("long")
    return (
        induced(trees.select("host", "skeleton"))
        .join(slots, F.col("host").eqNullSafe(F.col("_host")) & (F.col("skeleton") == F.col("_skeleton")), "left")
        .select(F.col("host").alias(host), "skeleton", "lines", F.coalesce("template_slots", zero).alias("template_slots"), F.coalesce("content_slots", zero).alias("content_slots"), F.col("template").alias("template_nodes"), "alignment")
    )


def _tree(skeleton: str) -> Node:
    """A skeleton read back as a tree."""
    stack: list[tuple[str, list]] = [("", [])]
    for name, sign in regex.findall(r"([^(),]*)([(),]|$)", skeleton):
        if name:
            node = (name, [])
            stack[-1][1].append(node)
            if sign == "(":
                stack.append(node)
        if sign == ")":
            stack.pop()
    return stack[0][1][0]


def _nodes(tree: Node) -> int:
    return 1 + sum(map(_nodes, tree[1])) if tree[0] != "#" else 1
