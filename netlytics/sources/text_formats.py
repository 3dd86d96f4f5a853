"""GML, DOT and Pajek: nested text formats, parsed whole, each file by one task.

The formats nest, so a file has no places at which it could be cut without reading what comes before.  A file is a
row (under 2 GB); many files are parsed side by side.  Text that a parser does not understand is an error
with its line, never passed over.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import GraphError, durable

MAX_COLUMNS = 1000
_ROW = "kind string, id string, label string, x double, y double, size double, r int, g int, b int, source string, target string, weight double, directed boolean, attributes string"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]


class ParseError(ValueError):
    """Text that is not of the format."""


def _at(text: str, place: int) -> str:
    return f"line {text.count(chr(10), 0, place) + 1}"


def _number(value: object) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _paint(value: object) -> dict:
    m = re.fullmatch(r"#([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})(?:[0-9a-fA-F]{2})?", value or "") if isinstance(value, str) else None
    return dict(zip("rgb", (int(x, 16) for x in m.groups()), strict=True)) if m else {}


# ---------------------------------------------------------------- GML

_GML = re.compile(r'(?:\s+|^[ \t]*#.*$)*(?:"(?P<text>[^"]*)"|(?P<mark>[\[\]])|(?P<word>[^\s\[\]"]+)|(?P<end>\Z))', re.M)


def _gml_tokens(text: str) -> Iterator[tuple[str, str, int]]:
    at = 0
    while True:
        m = _GML.match(text, at)
        if m is None:
            raise ParseError(f"{_at(text, at)}: a quotation mark without its end")
        if m.lastgroup == "end":
            return
        yield m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)
        at = m.end()


def parse_gml(text: str) -> Iterator[dict]:
    """Rows of the nodes and edges; lists inside them become names with points, ``graphics`` gives place, size and colour."""
    directed, path, element, key = False, [], None, None  # path: names of the open lists; element: the node or edge that is read
    for kind, value, place in _gml_tokens(text):
        if kind == "mark" and value == "[":
            if key is None:
                raise ParseError(f"{_at(text, place)}: a list without a name")
            path.append(key.lower())
            if path == ["graph", "node"] or path == ["graph", "edge"]:
                element = {}
            key = None
        elif kind == "mark":
            if key is not None or not path:
                raise ParseError(f"{_at(text, place)}: an end without a beginning")
            if len(path) == 2 and element is not None:
                yield _gml_row(path[1], element, directed, _at(text, place))
                element = None
            path.pop()
        elif key is None:
            if kind != "word":
                raise ParseError(f"{_at(text, place)}: a name expected")
            key = value
        else:
            value = html.unescape(value) if kind == "text" else value
            if path == ["graph"] and key.lower() == "directed":
                directed = value == "1"
            elif element is not None and len(path) >= 2:
                element[".".join([*path[2:], key])] = value
            key = None
    if path or key is not None:
        raise ParseError("the text ends inside a list")


def _gml_row(kind: str, element: dict, directed: bool, where: str) -> dict:
    low = {k.lower(): k for k in element}
    take = lambda name: element.pop(low[name]) if low.get(name) in element else None
    if kind == "node":
        name = take("id")
        if name is None:
            raise ParseError(f"{where}: a node without an id")
        label = take("label")
        sizes = [_number(take(f"graphics.{c}")) for c in "dwh"]
        return {"kind": "node", "id": name, "label": name if label is None else label, "x": _number(take("graphics.x")), "y": _number(take("graphics.y")), "size": next((s for s in sizes if s is not None), None), **_paint(take("graphics.fill")), "attributes": element}
    source, target = take("source"), take("target")
    if source is None or target is None:
        raise ParseError(f"{where}: an edge without both ends")
    own = take("directed")
    weight = _number(take("weight") if "weight" in low else take("value"))
    return {"kind": "edge", "source": source, "target": target, "label": take("label"), "weight": 1.0 if weight is None else weight, "directed": directed if own is None else own == "1", "attributes": element}


# ---------------------------------------------------------------- DOT

_DOT = re.compile(
    r'(?:\s+|//[^\n]*|/\*.*?\*/|^#[^\n]*)*(?:(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<mark>->|--|[{}\[\];,=:+])|(?P<word>-?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)|[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)|(?P<open><)|(?P<end>\Z))', re.S | re.M
)


class _Dot:
    """Recursive descent over the statements of a DOT graph."""

    def __init__(self, text: str):
        self.text, self.at, self.held = text, 0, None
        self.nodes: dict[str, dict] = {}
        self.edges: list[tuple[str, str, dict]] = []

    def fail(self, what: str):
        raise ParseError(f"{_at(self.text, self.at)}: {what}")

    def next(self) -> tuple[str, str]:
        if self.held is not None:
            token, self.held = self.held, None
            return token
        m = _DOT.match(self.text, self.at)
        if m is None:
            self.fail(f"not understood: {self.text[self.at : self.at + 20].strip()!r}")
        self.at = m.end()
        if m.lastgroup == "open":  # an HTML string ends with the mark that closes its first one
            depth, start = 1, self.at
            while depth and self.at < len(self.text):
                depth += {"<": 1, ">": -1}.get(self.text[self.at], 0)
                self.at += 1
            if depth:
                self.fail("an HTML string without its end")
            return "name", self.text[start : self.at - 1]
        if m.lastgroup == "quoted":
            return "name", re.sub(r"\\\n", "", m["quoted"][1:-1]).replace('\\"', '"')
        return {"word": "word", "mark": "mark", "end": "end"}[m.lastgroup], m[m.lastgroup]

    def peek(self) -> tuple[str, str]:
        self.held = self.next()
        return self.held

    def take(self, mark: str) -> bool:
        if self.peek() == ("mark", mark):
            self.held = None
            return True
        return False

    def name(self) -> str:
        kind, value = self.next()
        if kind not in ("name", "word"):
            self.fail(f"a name expected, not {value!r}")
        while kind == "name" and self.take("+"):
            value += self.next()[1]
        return value

    def attributes(self) -> dict:
        out = {}
        while self.take("["):
            while not self.take("]"):
                key = self.name()
                out[key] = self.name() if self.take("=") else "true"
                self.take(",") or self.take(";")
        return out

    def graph(self) -> None:
        kind, word = self.next()
        if word.lower() == "strict":
            kind, word = self.next()
        if kind != "word" or word.lower() not in ("graph", "digraph"):
            self.fail("graph or digraph expected")
        self.directed = word.lower() == "digraph"
        if self.peek() != ("mark", "{"):
            self.name()
        if not self.take("{"):
            self.fail("{ expected")
        self.statements({}, {})
        if self.next()[0] != "end":
            self.fail("text after the graph")

    def statements(self, node: dict, edge: dict) -> list[str]:
        """Statements up to the closing mark; the names of the nodes in them."""
        node, edge, names = dict(node), dict(edge), []
        while not self.take("}"):
            if self.take(";") or self.take(","):
                continue
            kind, word = self.peek()
            if kind == "end":
                self.fail("} expected")
            if kind == "word" and word.lower() in ("graph", "node", "edge"):
                self.held = None
                found = self.attributes()
                (node if word.lower() == "node" else edge if word.lower() == "edge" else {}).update(found)
                continue
            ends = self.end(node, edge)
            if isinstance(ends, str) and self.take("="):  # a setting of the graph
                self.name()
                continue
            chain, marks = [ends], []
            while self.peek() in (("mark", "->"), ("mark", "--")):
                marks.append(self.next()[1])
                chain.append(self.end(node, edge))
            found = self.attributes() if len(chain) > 1 or isinstance(ends, str) else {}
            for e in chain:
                for n in [e] if isinstance(e, str) else e:
                    self.nodes.setdefault(n, dict(node))
                    names.append(n)
            if len(chain) == 1 and isinstance(ends, str):
                self.nodes[ends].update(found)
            for a, b, mark in zip(chain, chain[1:], marks, strict=False):
                if (mark == "->") != self.directed:
                    self.fail(f"{mark} in a graph of the other kind")
                for s in [a] if isinstance(a, str) else a:
                    for t in [b] if isinstance(b, str) else b:
                        self.edges.append((s, t, edge | found))
        return list(dict.fromkeys(names))

    def end(self, node: dict, edge: dict) -> str | list[str]:
        """A node's name without its port, or the nodes of a subgraph."""
        kind, word = self.peek()
        if kind == "word" and word.lower() == "subgraph":
            self.held = None
            if self.peek() != ("mark", "{"):
                self.name()
        if self.take("{"):
            return self.statements(node, edge)
        name = self.name()
        while self.take(":"):
            self.name()
        return name


def parse_dot(text: str) -> Iterator[dict]:
    """Rows of the nodes and edges: statements in any number of lines, chains, subgraphs, defaults, ports."""
    dot = _Dot(text)
    dot.graph()
    for name, given in dot.nodes.items():
        place = re.match(r"\s*([^,\s]+),([^,!\s]+)", given.pop("pos", ""))
        size, label = _number(given.get("width")), given.pop("label", name)
        yield {"kind": "node", "id": name, "label": name if label == "\\N" else label, "x": _number(place[1]) if place else None, "y": _number(place[2]) if place else None, "size": size, **_paint(given.get("fillcolor", given.get("color"))), "attributes": given}
    for source, target, given in dot.edges:
        given = dict(given)
        weight = _number(given.pop("weight", None))
        yield {"kind": "edge", "source": source, "target": target, "label": given.pop("label", None), "weight": 1.0 if weight is None else weight, "directed": dot.directed, **_paint(given.get("color")), "attributes": given}


# ---------------------------------------------------------------- Pajek

_CELL = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')


def parse_pajek(text: str) -> Iterator[dict]:
    """Rows of vertices (number, label, place), arcs and edges in pairs, in lists and as a matrix."""
    part, row = "", 0
    for i, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("%"):
            continue
        if line.startswith("*"):
            part, row = line.split()[0].lower().rstrip(":"), 0
            if part not in ("*network", "*vertices", "*arcs", "*edges", "*arcslist", "*edgeslist", "*matrix"):
                raise ParseError(f"line {i}: the section {part} is not known")
            if part == "*vertices":
                count = line.split()[1:2]
                for n in range(1, int(count[0]) + 1 if count and count[0].isdigit() else 1):
                    yield {"kind": "node", "id": str(n), "label": None, "attributes": {}}
            continue
        cells = [m[1] if m[1] is not None else m[2] for m in _CELL.finditer(line)]
        edge = {"kind": "edge", "attributes": {}, "directed": not part.startswith("*edges")}
        if part == "*vertices":
            numbers = [_number(c) for c in cells[2:4]]
            if not cells[0].isdigit():
                raise ParseError(f"line {i}: a number expected")
            place = dict(zip(("x", "y"), numbers, strict=False)) if len(numbers) == 2 and None not in numbers else {}
            yield {"kind": "node", "id": cells[0], "label": cells[1] if len(cells) > 1 else cells[0], **place, "attributes": {}}
        elif part in ("*arcs", "*edges"):
            weight = _number(cells[2]) if len(cells) > 2 else 1.0
            if len(cells) < 2 or weight is None:
                raise ParseError(f"line {i}: two vertices and a weight expected")
            yield edge | {"source": cells[0], "target": cells[1], "weight": weight}
        elif part in ("*arcslist", "*edgeslist"):
            yield from (edge | {"source": cells[0], "target": t, "weight": 1.0} for t in cells[1:])
        elif part == "*matrix":
            row += 1
            values = [_number(c) for c in cells]
            if None in values:
                raise ParseError(f"line {i}: numbers expected")
            yield from (edge | {"source": str(row), "target": str(k), "weight": w} for k, w in enumerate(values, 1) if w)
        else:
            raise ParseError(f"line {i}: text before the first section")


# ---------------------------------------------------------------- tables

PARSERS = {"gml": parse_gml, "dot": parse_dot, "net": parse_pajek}


def parsed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of the files at ``path``, in batches as the parser gives them."""
    parse = PARSERS[kind]

    def run(batches):
        def frame(rows):
            table = pd.DataFrame([{**r, "attributes": json.dumps(r["attributes"])} for r in rows]).reindex(columns=_NAMES)
            return table.astype(object).where(table.notna(), None)

        for batch in batches:
            for text in batch["value"]:
                held = []
                for row in parse(text.lstrip("﻿")):
                    held.append(row)
                    if len(held) == 10_000:
                        yield frame(held)
                        held = []
                yield frame(held)

    return durable(spark.read.text(path, wholetext=True).mapInPandas(run, _ROW))


def with_attributes(df: DataFrame, taken: tuple) -> DataFrame:
    """The ``attributes`` of rows as columns, of the narrowest type that fits all their values; names that are taken get a line after them."""
    given = F.from_json("attributes", "map<string,string>")
    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(given)).alias("k")).distinct().limit(MAX_COLUMNS + 1).collect())
    if len(names) > MAX_COLUMNS:
        raise GraphError(f"more than {MAX_COLUMNS} attributes")
    df = df.withColumn("__given", given).drop("attributes")
    if not names:
        return df.drop("__given")
    value = lambda n: F.try_element_at("__given", F.lit(n))
    fits = lambda n, kind: F.bool_and(value(n).isNull() | value(n).try_cast(kind).isNotNull())
    kinds = df.agg(*[fits(n, k).alias(f"{i}_{k}") for i, n in enumerate(names) for k in ("bigint", "double")]).first()
    kind = lambda i: "bigint" if kinds[f"{i}_bigint"] else "double" if kinds[f"{i}_double"] else "string"
    out, used = {}, {t.lower() for t in taken}
    for i, n in enumerate(names):
        name = n.replace("`", "'")
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out[name] = value(n).try_cast(kind(i))
    return df.withColumns(out).drop("__given")
