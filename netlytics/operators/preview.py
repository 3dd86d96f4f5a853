"""Rendering settings: typed values by name."""

from __future__ import annotations

from ..functions.values import colour, font
from ..graph import Graph, GraphError
from .appearance import color_edges_by_endpoint

#: The settings with their kinds and first values.
SETTINGS = {
    "background-color": ("colour", "#ffffff"),
    "directed": ("bool", True),
    "visibility-ratio": ("float", 1.0),
    "margin": ("float", 5.0),
    "node.border.width": ("float", 1.0),
    "node.border.color": ("dependent", "#000000"),
    "node.opacity": ("float", 100.0),
    "node.per-node-opacity": ("bool", False),
    "node.label.show": ("bool", False),
    "node.label.font": ("font", "Arial 12"),
    "node.label.color": ("original", "original"),
    "node.label.proportinalSize": ("bool", True),
    "node.label.shorten": ("bool", False),
    "node.label.max-char": ("int", 30),
    "node.label.outline.size": ("float", 0.0),
    "node.label.outline.color": ("dependent", "#ffffff"),
    "node.label.outline.opacity": ("float", 80.0),
    "node.label.box": ("bool", False),
    "node.label.box.color": ("dependent", "parent"),
    "node.label.box.opacity": ("float", 100.0),
    "edge.show": ("bool", True),
    "edge.thickness": ("float", 1.0),
    "edge.rescale-weight": ("bool", False),
    "edge.rescale-weight.min": ("float", 0.1),
    "edge.rescale-weight.max": ("float", 10.0),
    "edge.color": ("edge", "original"),
    "edge.opacity": ("float", 100.0),
    "edge.curved": ("bool", True),
    "edge.radius": ("float", 0.0),
    "edge.label.show": ("bool", False),
    "edge.label.font": ("font", "Arial 10"),
    "edge.label.color": ("original", "original"),
    "edge.label.shorten": ("bool", False),
    "edge.label.max-char": ("int", 30),
    "edge.label.outline.size": ("float", 2.0),
    "edge.label.outline.color": ("dependent", "#ffffff"),
    "edge.label.outline.opacity": ("float", 80.0),
    "arrow.size": ("float", 3.0),
}
_WORDS = {"dependent": ("parent", "darker"), "original": ("parent", "original"), "edge": ("mixed", "original", "source", "target")}


def _hex(text: str) -> str:
    return "#{:02x}{:02x}{:02x}".format(*colour(text))


def _parse(kind: str, value: object) -> object:
    if kind == "bool":
        return str(value).lower() == "true"
    if kind == "float":
        return float(str(value))
    if kind == "int":
        return int(str(value))
    if not isinstance(value, str):
        raise GraphError("text expected")
    if kind == "font":
        f = font(value)
        return " ".join([f["name"], str(f["size"]), *(["Bold"] if f["bold"] else []), *(["Italic"] if f["italic"] else [])])
    if kind == "colour":
        return _hex(value)
    word = value.strip().lower()
    return word if word in _WORDS[kind] else _hex(word)


def get_preview_settings(graph: Graph) -> dict:
    return {k: v for k, (_, v) in SETTINGS.items()} | graph.preview


def set_preview_settings(graph: Graph, settings: dict) -> tuple[Graph, dict]:
    """Set what is known and can be read; nulls, unknown names and bad values are passed over. Colouring edges by their source or target is a join."""
    done, new = 0, {}
    for name, value in settings.items():
        if value is None or name not in SETTINGS:
            continue
        try:
            new[name] = _parse(SETTINGS[name][0], value)
        except ValueError:
            continue
        done += 1
        if name == "edge.color" and new[name] in ("source", "target"):
            graph = color_edges_by_endpoint(graph, new[name])
            new[name] = "original"
    return graph.with_(preview=graph.preview | new), {"properties_set": done}
