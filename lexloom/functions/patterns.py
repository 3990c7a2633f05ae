"""Pattern algebra: small pattern trees that compile to one expression for finding spans and read structure out of each.

A pattern is built from text patterns, sequences, ordered choices, repetitions and named groups. Finding works on folded
text; what is returned is always sliced from the original, since folding keeps offsets. ``find`` yields plain text
between matches and ``Found`` trees for matches; ``find_all`` is the same over a column, one struct per span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import grammar as G

_TABLE = str.maketrans(G.FOLD_FROM, G.FOLD_TO)


def folded(text: str) -> str:
    """Folding of one text; a letter whose lower case is longer stays as it is, so offsets hold."""
    low = text.lower()
    return (low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)).translate(_TABLE)


@dataclass(frozen=True)
class Pattern:
    """A node: its kind, its own expression (text nodes) and its children."""

    kind: str
    source: str = ""
    children: tuple[Pattern, ...] = ()
    name: str = ""
    least: int = 1
    most: int | None = 1
    separator: str = ""

    @property
    def expression(self) -> str:
        """The whole node as one expression without names."""
        if self.kind == "text":
            return f"(?:{regex.sub(r'[(][?]P?<[A-Za-z_]+>', '(?:', self.source)})"
        inner = [c.expression for c in self.children]
        if self.kind == "choice":
            return f"(?:{'|'.join(inner)})"
        if self.kind == "repeat":
            return repeated(inner[0], self.least, self.most, self.separator)
        return f"(?:{''.join(inner)})"


def text(source: str, name: str = "") -> Pattern:
    """A text pattern over folded text; its named groups, or the whole under ``name``, are captured."""
    return Pattern("text", f"(?P<{name}>{source})" if name else source)


def _node(x: Pattern | str) -> Pattern:
    return text(x) if isinstance(x, str) else x


def sequence(*parts: Pattern | str) -> Pattern:
    return Pattern("sequence", children=tuple(map(_node, parts)))


def choice(*parts: Pattern | str) -> Pattern:
    """The first alternative that matches, so the most specific comes first."""
    return Pattern("choice", children=tuple(map(_node, parts)))


def repeat(part: Pattern | str, least: int = 0, most: int | None = None, separator: str = "") -> Pattern:
    return Pattern("repeat", children=(_node(part),), least=least, most=most, separator=separator)


def group(name: str, part: Pattern | str) -> Pattern:
    return Pattern("group", children=(_node(part),), name=name)


def repeated(expression: str, least: int, most: int | None, separator: str = "") -> str:
    """``least`` to ``most`` times an expression, with a separator between two of them."""
    if not separator:
        return f"(?:{expression}){{{least},{'' if most is None else most}}}"
    more = f"(?:(?:{separator}){expression}){{{max(least - 1, 0)},{'' if most is None else most - 1}}}"
    return f"(?:{expression}{more})" + ("?" if least == 0 else "")


@dataclass
class Found:
    """A match: its text, its captures (the last of each name) and its named groups in order."""

    text: str
    start: int
    name: str = ""
    captures: dict[str, str] = field(default_factory=dict)
    groups: list[Found] = field(default_factory=list)


def _descend(node: Pattern, original: str, flat: str, start: int, end: int, into: Found) -> None:
    """Read captures and groups of ``node`` out of its span."""
    span = flat[start:end]
    if node.kind == "text":
        if m := regex.match(node.source, span):
            into.captures.update({k: original[start + m.start(k) : start + m.end(k)] for k, v in m.groupdict().items() if v is not None})
    elif node.kind == "group":
        inner = Found(original[start:end], start, node.name)
        _descend(node.children[0], original, flat, start, end, inner)
        into.groups.append(inner)
    elif node.kind == "choice":
        for child in node.children:
            if m := regex.match(child.expression, span):
                return _descend(child, original, flat, start, start + m.end(), into)
    elif node.kind == "sequence":
        whole = regex.match("".join(f"({c.expression})" for c in node.children), span) if all("(" not in regex.sub(r"\\.|\(\?:", "", c.expression) for c in node.children) else None
        at = start
        for i, child in enumerate(node.children, 1):
            if whole:
                a, b = start + whole.start(i), start + whole.end(i)
            else:
                rest = "".join(c.expression for c in node.children[i:])
                m = regex.match(f"(?P<own>{child.expression}){rest}", flat[at:end]) or regex.match(f"(?P<own>{child.expression})", flat[at:end])
                if not m:
                    return None
                a, b = at, at + m.end("own")
            if b > a:
                _descend(child, original, flat, a, b, into)
            at = b
    elif node.kind == "repeat":
        at = start
        for m in regex.finditer(node.children[0].expression, span):
            if m.end() > m.start() and start + m.start() >= at:
                _descend(node.children[0], original, flat, start + m.start(), start + m.end(), into)
                at = start + m.end()
    return None


def find(pattern: Pattern, string: str, fold: bool = True) -> Iterator[str | Found]:
    """Text between matches and matches, in order; empty text is left out. Without ``fold`` case and accents count."""
    flat, at = folded(string) if fold else string, 0
    for m in regex.finditer(pattern.expression, flat):
        if m.end() == m.start():
            continue
        if m.start() > at:
            yield string[at : m.start()]
        out = Found(string[m.start() : m.end()], m.start())
        _descend(pattern, string, flat, m.start(), m.end(), out)
        yield out
        at = m.end()
    if at < len(string):
        yield string[at:]


def render(flow: Iterator[str | Found], fn: Callable[[Found], str], allowed: set[str] | None = None) -> str:
    """A flow put back into one text, matches through ``fn``. With ``allowed`` a group of another name is an error."""
    return "".join(map_found(flow, fn, allowed))


def map_found(flow: Iterator[str | Found], fn: Callable[[Found], object], allowed: set[str] | None = None) -> Iterator:
    """A flow with ``fn`` of each match in its place."""
    for x in flow:
        if isinstance(x, Found) and allowed is not None:
            for g in x.groups:
                if g.name not in allowed:
                    raise ValueError(f"unexpected group {g.name}")
        yield x if isinstance(x, str) else fn(x)


def flat_map_found(flow: Iterator[str | Found], fn: Callable[[Found], Iterator]) -> Iterator:
    """A flow with the items of ``fn`` of each match in its place."""
    for x in flow:
        if isinstance(x, str):
            yield x
        else:
            yield from fn(x)


def flat_map_texts(flow: Iterator, fn: Callable[[str], Iterator]) -> Iterator:
    """A flow whose texts are replaced by the items of ``fn``; elements pass through."""
    for x in flow:
        if isinstance(x, str):
            yield from fn(x)
        else:
            yield x


def split_groups(found: Found) -> Iterator[str | Found]:
    """A match as the text between its named groups and the groups, in order; nested and empty groups are left out."""
    at = 0
    for g in sorted(found.groups, key=lambda g: (g.start, -len(g.text))):
        start = g.start - found.start
        if start < at or not g.text:
            continue
        if start > at:
            yield found.text[at:start]
        yield g
        at = start + len(g.text)
    if at < len(found.text):
        yield found.text[at:]


def texts_of(found: Found) -> list[str]:
    """The texts a match consists of, groups in their place."""
    return [x if isinstance(x, str) else x.text for x in split_groups(found)]


def children_of(found: Found, *names: str) -> list[Found]:
    """The groups directly below a match that have one of the names."""
    return [g for g in found.groups if g.name in names]


def sub_again(pattern: str, by: str, string: str) -> str:
    """Replacement that searches again in what is left behind each hit, so an anchored pattern holds there anew."""
    flat, out, at = folded(string), [], 0
    while m := regex.compile(pattern).search(flat[at:]):
        if m.end() == m.start():
            break
        out += [string[at : at + m.start()], by]
        at += m.end()
    return "".join(out) + string[at:]


def split_before(pile: list[str], pattern: str) -> list[str]:
    """A pile of lines joined with spaces and cut before each hit of a pattern; blank pieces are left out."""
    text = " ".join(pile)
    cuts = [0, *[m.start() for m in regex.finditer(pattern, folded(text)) if m.end() > m.start()], len(text)]
    return [x for a, b in zip(cuts, cuts[1:], strict=False) if (x := text[a:b].strip())]


def with_siblings(flow: Iterator[str | Found], previous: bool = False) -> list[str]:
    """Each match together with the text after it, or with the text before it; what is left over is a piece of its own."""
    out, held = [], ""
    for x in flow:
        if isinstance(x, str):
            held += x
        elif previous:
            out.append(held + x.text)
            held = ""
        else:
            out.append(held)
            held = x.text
    return [x for x in [*out, held] if x]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("captures", T.MapType(T.StringType(), T.StringType()))]))


def find_all(pattern: Pattern, column: Column) -> Column:
    """Spans of a column: start, original text and captures of each match (groups' captures included, last wins)."""

    def all_captures(f: Found) -> dict[str, str]:
        out = dict(f.captures)
        for g in f.groups:
            out |= all_captures(g)
        return out

    def spans(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [{"start": f.start, "text": f.text, "captures": all_captures(f)} for f in find(pattern, v) if isinstance(f, Found)])

    return F.pandas_udf(spans, _SPAN)(column)
