"""Drawings: SVG line by line from the DataFrames, PNG and PDF rastered or drawn on the driver.

An SVG of any size is written by tasks.  PNG and PDF are pictures for a screen or a page: at most
``MAX_PRIMITIVES`` nodes and edges are drawn; larger graphs are refused, not thinned out.

SVG follows all preview settings.  PDF leaves out label outlines and boxes; PNG has no text at all, since a raster needs
a font's shapes, and none is at hand.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import font
from ..graph import Graph, GraphError
from ..operators.appearance import edge_thickness
from ..operators.preview import get_preview_settings
from .tables import _frame_rows, _write_lines, _xml

MAX_PRIMITIVES = 500_000


def _positions(graph: Graph) -> DataFrame:
    zero = F.lit(0.0).cast("float")
    return graph.nodes.select("id", F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"))


def _bounds(graph: Graph) -> tuple[float, float, float, float]:
    p = _positions(graph).join(graph.nodes.select("id", F.coalesce("size", F.lit(1.0)).alias("s")), "id")
    lo_x, lo_y, hi_x, hi_y = p.agg(F.min(F.col("x") - F.col("s")), F.min(F.col("y") - F.col("s")), F.max(F.col("x") + F.col("s")), F.max(F.col("y") + F.col("s"))).first()
    return (lo_x or 0.0, lo_y or 0.0, hi_x or 1.0, hi_y or 1.0)


BEND = 0.2  # how far a curved edge's middle is from the straight line, as a share of its length


def edge_primitives(graph: Graph) -> DataFrame:
    """(seq, x1, y1, x2, y2, r, g, b, thickness, label, directed, reach): the line between two nodes' borders, and ``reach``, from its end to the target's centre."""
    p = _positions(graph).join(graph.nodes.select("id", (F.coalesce("size", F.lit(0.0)) / 2).alias("w")), "id")
    e = graph.edges.select("seq", "source", "target", "r", "g", "b", "label", "directed").join(p.toDF("source", "x1", "y1", "w1"), "source").join(p.toDF("target", "x2", "y2", "w2"), "target")
    radius = float(get_preview_settings(graph)["edge.radius"])
    if radius:  # ends keep a distance from the nodes' borders
        d = F.greatest(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)), F.lit(1e-6))
        a, b = F.least((F.col("w1") + radius) / d, F.lit(0.5)), F.least((F.col("w2") + radius) / d, F.lit(0.5))
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        e = e.withColumns({"x1": F.col("x1") + dx * a, "y1": F.col("y1") + dy * a, "x2": F.col("x2") - dx * b, "y2": F.col("y2") - dy * b, "w2": F.lit(0.0)})
    return e.join(edge_thickness(graph), "seq").select("seq", "x1", "y1", "x2", "y2", "r", "g", "b", "thickness", "label", "directed", F.col("w2").alias("reach"))


def _hex(setting: str):
    """A colour setting over the columns r, g, b: the element's own, a darker one, or a fixed one."""
    if setting in ("parent", "original"):
        return F.format_string("#%02x%02x%02x", "r", "g", "b")
    if setting == "darker":
        return F.format_string("#%02x%02x%02x", *[(F.col(c) * 0.7).cast("int") for c in "rgb"])
    return F.lit(setting)


def _number(column):
    return F.round(column.cast("double"), 4).cast("string")


def _tag(name: str, body=None, **attributes):
    """An element of constants and columns."""
    parts = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        parts += [F.lit(f' {key.replace("_", "-")}="'), value if hasattr(value, "cast") else F.lit(str(value)), F.lit('"')]
    return F.concat(*parts, *([F.lit("/>")] if body is None else [F.lit(">"), body, F.lit(f"</{name}>")]))


def _text_of(s: dict, kind: str, label, x, y, scale):
    """A label with its font, outline and box."""
    f = font(s[f"{kind}.label.font"])
    if s[f"{kind}.label.shorten"]:
        label = F.substring(label, 1, int(s[f"{kind}.label.max-char"]))
    size = F.lit(float(f["size"])) * scale
    look = {"font_family": f["name"], "font_weight": "bold" if f["bold"] else "normal", "font_style": "italic" if f["italic"] else "normal"}
    if s[f"{kind}.label.outline.size"]:
        look |= {"stroke": _hex(s[f"{kind}.label.outline.color"]), "stroke_width": s[f"{kind}.label.outline.size"], "stroke_opacity": s[f"{kind}.label.outline.opacity"] / 100, "paint_order": "stroke"}
    out = _tag("text", _xml(label), text_anchor="middle", x=_number(x), y=_number(y), font_size=_number(size), fill=_hex(s[f"{kind}.label.color"]), **look)
    if kind == "node" and s["node.label.box"]:
        width = F.length(label) * size * 0.6
        out = F.concat(_tag("rect", x=_number(x - width / 2), y=_number(y - size), width=_number(width), height=_number(size * 1.3), fill=_hex(s["node.label.box.color"]), fill_opacity=s["node.label.box.opacity"] / 100), out)
    return F.when(F.coalesce(label, F.lit("")) != "", out).otherwise(F.lit(""))


def write_svg(graph: Graph, path: str) -> None:
    s = get_preview_settings(graph)
    x0, y0, x1, y1 = _bounds(graph)
    mx, my = (x1 - x0) * s["margin"] / 100, (y1 - y0) * s["margin"] / 100
    x0, y0, x1, y1 = x0 - mx, y0 - my, x1 + mx, y1 + my
    head = ['<?xml version="1.0" encoding="UTF-8"?>', f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x0} {y0} {x1 - x0} {y1 - y0}">', f'<rect x="{x0}" y="{y0}" width="{x1 - x0}" height="{y1 - y0}" fill="{s["background-color"]}"/>']
    drawn = Graph(graph.nodes, edge_primitives(graph) if s["edge.show"] else edge_primitives(graph).where(F.lit(False)))

    ax, ay, bx, by = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    mid_x, mid_y = (ax + bx) / 2, (ay + by) / 2
    if s["edge.curved"]:
        cx, cy = mid_x + (by - ay) * BEND, mid_y - (bx - ax) * BEND
        line = F.concat(F.lit("M "), _number(ax), F.lit(","), _number(ay), F.lit(" Q "), _number(cx), F.lit(","), _number(cy), F.lit(" "), _number(bx), F.lit(","), _number(by))
        mid_x, mid_y = (mid_x + cx) / 2, (mid_y + cy) / 2
    else:
        cx, cy = ax, ay
        line = F.concat(F.lit("M "), _number(ax), F.lit(","), _number(ay), F.lit(" L "), _number(bx), F.lit(","), _number(by))
    opacity = s["edge.opacity"] / 100
    edge = _tag("path", d=line, stroke=_hex("original"), stroke_width=_number(F.col("thickness")), stroke_opacity=opacity, fill="none")
    if s["directed"] and s["arrow.size"]:  # a head that ends at the target's border
        way = F.greatest(F.sqrt((bx - cx) * (bx - cx) + (by - cy) * (by - cy)), F.lit(1e-6))
        ux, uy = (bx - cx) / way, (by - cy) / way
        size = F.lit(float(s["arrow.size"])) * F.greatest(F.col("thickness"), F.lit(0.5))
        tip_x, tip_y = bx - ux * F.col("reach"), by - uy * F.col("reach")
        points = [(tip_x, tip_y), (tip_x - ux * size - uy * size / 2, tip_y - uy * size + ux * size / 2), (tip_x - ux * size + uy * size / 2, tip_y - uy * size - ux * size / 2)]
        corners = F.concat_ws(" ", *[F.concat(_number(x), F.lit(","), _number(y)) for x, y in points])
        edge = F.concat(edge, F.when(F.col("directed"), _tag("polygon", points=corners, fill=_hex("original"), fill_opacity=opacity)).otherwise(F.lit("")))
    if s["edge.label.show"]:
        edge = F.concat(edge, _text_of(s, "edge", F.col("label"), mid_x, mid_y, F.lit(1.0)))

    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    fill = F.round(F.col("a") / 255.0, 4).cast("string") if s["node.per-node-opacity"] else s["node.opacity"] / 100
    border = {"stroke": _hex(s["node.border.color"]), "stroke_width": s["node.border.width"]} if s["node.border.width"] else {}
    node = _tag("circle", cx=_number(x), cy=_number(y), r=_number(F.col("size") / 2), fill=_hex("original"), fill_opacity=fill, **border)
    if s["node.label.show"]:
        scale = F.col("size").cast("double") / 10 if s["node.label.proportinalSize"] else F.lit(1.0)
        node = F.concat(node, _text_of(s, "node", F.col("label"), x, y, scale))
    # Edges lie under nodes.
    rows = _frame_rows(drawn, head, node, [], edge, ["</svg>"])
    order = F.when(F.col("block") == 1, 3).when(F.col("block") == 3, 1).otherwise(F.col("block"))
    _write_lines(rows.withColumn("block", order), path)


def _collected(graph: Graph):
    if graph.nodes.count() + graph.edges.count() > MAX_PRIMITIVES:
        raise GraphError(f"more than {MAX_PRIMITIVES} nodes and edges; write an SVG")
    edges = edge_primitives(graph).orderBy("seq")
    edges = (edges if get_preview_settings(graph)["edge.show"] else edges.limit(0)).toPandas()
    nodes = graph.nodes.orderBy("seq").select("x", "y", "size", "r", "g", "b", F.coalesce("label", F.lit("")).alias("label")).na.fill(0).toPandas()
    return nodes, edges


def _rgb(setting: str, own: tuple) -> tuple:
    if setting in ("parent", "original"):
        return own
    return tuple(int(c * 0.7) for c in own) if setting == "darker" else tuple(int(setting[i : i + 2], 16) for i in (1, 3, 5))


def _scale(graph: Graph, width: float, height: float):
    x0, y0, x1, y1 = _bounds(graph)
    k = min(width / max(x1 - x0, 1e-9), height / max(y1 - y0, 1e-9)) * 0.95
    return k, width / 2 - k * (x0 + x1) / 2, height / 2 - k * (y0 + y1) / 2


def write_png(graph: Graph, file: str, width: int = 1920, height: int = 1080) -> None:
    s = get_preview_settings(graph)
    nodes, edges = _collected(graph)
    k, ox, oy = _scale(graph, width, height)
    picture = np.empty((height, width, 3), np.float32)
    picture[:] = _rgb(s["background-color"], (255, 255, 255))

    def blend(ys, xs, colour, opacity):
        ok = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        at = np.unique(ys[ok].astype(np.int64) * width + xs[ok])  # a place is painted once for each element
        ys, xs = at // width, at % width
        picture[ys, xs] = picture[ys, xs] * (1 - opacity) + np.array(colour, np.float32) * opacity

    bend = BEND if s["edge.curved"] else 0.0
    for e in edges.itertuples():
        n = int(max(abs(e.x2 - e.x1), abs(e.y2 - e.y1)) * k * (1 + bend)) * 2 + 2
        t = np.linspace(0, 1, n)
        cx, cy = (e.x1 + e.x2) / 2 + (e.y2 - e.y1) * bend, (e.y1 + e.y2) / 2 - (e.x2 - e.x1) * bend
        xs = ((1 - t) ** 2 * e.x1 + 2 * t * (1 - t) * cx + t * t * e.x2) * k + ox
        ys = ((1 - t) ** 2 * e.y1 + 2 * t * (1 - t) * cy + t * t * e.y2) * k + oy
        half = min(8, max(0, int(e.thickness * k / 2)))
        spread = np.arange(-half, half + 1)
        blend((ys[:, None, None] + spread[None, :, None] + 0 * spread[None, None, :]).astype(int).ravel(), (xs[:, None, None] + 0 * spread[None, :, None] + spread[None, None, :]).astype(int).ravel(), (e.r, e.g, e.b), s["edge.opacity"] / 100)
    for v in nodes.itertuples():
        cx, cy, r, rim = v.x * k + ox, v.y * k + oy, max(1.0, v.size * k / 2), s["node.border.width"] * k
        ya, xa = np.mgrid[max(0, int(cy - r - rim)) : min(height, int(cy + r + rim) + 2), max(0, int(cx - r - rim)) : min(width, int(cx + r + rim) + 2)]
        d = np.hypot(xa - cx, ya - cy)
        for inside, colour in ((d <= r + rim / 2, _rgb(s["node.border.color"], (v.r, v.g, v.b))), (d <= max(r - rim / 2, r * 0.5), (v.r, v.g, v.b))):
            blend(ya[inside], xa[inside], colour, s["node.opacity"] / 100)
    picture = picture.round().astype(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate((np.zeros((height, 1), np.uint8), picture.reshape(height, width * 3)), axis=1).tobytes()
    with open(file, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b""))


def write_pdf(graph: Graph, file: str, width: int = 0, height: int = 0) -> None:
    """One page of vector drawing; width and height in points, A4 across when not given."""
    s = get_preview_settings(graph)
    w, h = width if width > 0 else 842, height if height > 0 else 595
    nodes, edges = _collected(graph)
    k, ox, oy = _scale(graph, w, h)
    paint = lambda rgb, mark: " ".join(f"{c / 255:.3f}" for c in rgb) + f" {mark}"
    out = [f"{paint(_rgb(s['background-color'], (255, 255, 255)), 'rg')} 0 0 {w} {h} re f", "/E gs"]
    bend = BEND if s["edge.curved"] else 0.0
    for e in edges.itertuples():
        x1, y1, x2, y2 = e.x1 * k + ox, h - e.y1 * k - oy, e.x2 * k + ox, h - e.y2 * k - oy
        line = f"{paint((e.r, e.g, e.b), 'RG')} {max(0.1, e.thickness * k):.3f} w {x1:.2f} {y1:.2f} m "
        cx, cy = (x1 + x2) / 2 - (y2 - y1) * bend, (y1 + y2) / 2 + (x2 - x1) * bend
        out.append(line + (f"{(x1 + 2 * cx) / 3:.2f} {(y1 + 2 * cy) / 3:.2f} {(x2 + 2 * cx) / 3:.2f} {(y2 + 2 * cy) / 3:.2f} {x2:.2f} {y2:.2f} c S" if bend else f"{x2:.2f} {y2:.2f} l S"))
        if s["directed"] and s["arrow.size"] and e.directed:
            way = max(np.hypot(x2 - x1, y2 - y1), 1e-6)
            ux, uy, size = (x2 - x1) / way, (y2 - y1) / way, s["arrow.size"] * max(e.thickness, 0.5) * k
            tx, ty = x2 - ux * e.reach * k, y2 - uy * e.reach * k
            out.append(f"{paint((e.r, e.g, e.b), 'rg')} {tx:.2f} {ty:.2f} m {tx - ux * size - uy * size / 2:.2f} {ty - uy * size + ux * size / 2:.2f} l {tx - ux * size + uy * size / 2:.2f} {ty - uy * size - ux * size / 2:.2f} l h f")
    out.append("/N gs")
    for v in nodes.itertuples():  # a circle from four curves
        x, y, r = v.x * k + ox, h - v.y * k - oy, max(0.5, v.size * k / 2)
        c = 0.5523 * r
        rim = f"{paint(_rgb(s['node.border.color'], (v.r, v.g, v.b)), 'RG')} {s['node.border.width'] * k:.3f} w " if s["node.border.width"] else ""
        out.append(
            f"{rim}{paint((v.r, v.g, v.b), 'rg')} {x + r:.2f} {y:.2f} m {x + r:.2f} {y + c:.2f} {x + c:.2f} {y + r:.2f} {x:.2f} {y + r:.2f} c {x - c:.2f} {y + r:.2f} {x - r:.2f} {y + c:.2f} {x - r:.2f} {y:.2f} c "
            f"{x - r:.2f} {y - c:.2f} {x - c:.2f} {y - r:.2f} {x:.2f} {y - r:.2f} c {x + c:.2f} {y - r:.2f} {x + r:.2f} {y - c:.2f} {x + r:.2f} {y:.2f} c {'B' if rim else 'f'}"
        )
    labels = [(v.label, v.x, v.y, (v.r, v.g, v.b), v.size / 10 if s["node.label.proportinalSize"] else 1.0, "node") for v in nodes.itertuples()] if s["node.label.show"] else []
    labels += [(e.label, (e.x1 + e.x2) / 2, (e.y1 + e.y2) / 2, (e.r, e.g, e.b), 1.0, "edge") for e in edges.itertuples() if e.label] if s["edge.label.show"] else []
    for text, x, y, own, scale, kind in labels:
        text = text[: int(s[f"{kind}.label.max-char"])] if s[f"{kind}.label.shorten"] else text
        size = font(s[f"{kind}.label.font"])["size"] * scale * k
        raw = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").decode("latin-1")
        out.append(f"BT {paint(_rgb(s[f'{kind}.label.color'], own), 'rg')} /F {size:.2f} Tf {x * k + ox - len(text) * size * 0.25:.2f} {h - y * k - oy - size / 3:.2f} Td ({raw}) Tj ET")
    body = zlib.compress("\n".join(out).encode("latin-1"))
    opacity = [s[f"{kind}.opacity"] / 100 for kind in ("edge", "node")]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {w} {h}]/Contents 4 0 R/Resources<</Font<</F 5 0 R>>/ExtGState<</E<</CA {opacity[0]}/ca {opacity[0]}>>/N<</CA {opacity[1]}/ca {opacity[1]}>>>>>>>>".encode(), f"<</Length {len(body)}/Filter/FlateDecode>>\nstream\n".encode() + body + b"\nendstream", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    with open(file, "wb") as f:
        f.write(b"%PDF-1.4\n")
        places = []
        for i, o in enumerate(objects, 1):
            places.append(f.tell())
            f.write(f"{i} 0 obj\n".encode() + o + b"\nendobj\n")
        start = f.tell()
        f.write(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places) + f"trailer\n<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{start}\n%%EOF\n".encode())
