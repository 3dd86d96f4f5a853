"""Layouts: positions by formula, by forces, and passes against overlap.

Forces are computed in tasks.  Attraction is a join of edges with positions.  Repulsion is exact for at most
``EXACT_NODES`` nodes, whose places go to every task.  Beyond it a tree of cells takes the place of the sum (Barnes & Hut 1986):
squares, each cut into four, with their masses and centres, in a table of at most ``MAX_CELLS`` smallest squares.  A square is taken as a whole where its width is under
``theta`` times its distance, or where it holds one node, else its four parts are.  The smallest are always taken whole: with at most ``MAX_CELLS`` nodes
they are 1/4096 of the picture wide, with more 1/256, where dense parts are pushed less exactly.  A round ends with a table written.
"""

from __future__ import annotations

import math
import threading
from dataclasses import asdict, dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, degrees, durable, edge_frame, node_frame, start_position, with_seq

EXACT_NODES, MAX_CELLS = 2000, 1 << 16


@dataclass
class Circular:
    radius: float = 500.0


@dataclass
class RandomLayout:
    size: float = 1000.0
    seed: int = 0


@dataclass
class FruchtermanReingold:
    area: float = 10000.0
    gravity: float = 10.0
    speed: float = 1.0


@dataclass
class ForceAtlas2:
    scalingRatio: float = 2.0
    gravity: float = 1.0
    linLogMode: bool = False
    strongGravityMode: bool = False
    edgeWeightInfluence: float = 1.0
    jitterTolerance: float = 1.0
    outboundAttractionDistribution: bool = False
    adjustSizes: bool = False
    barnesHutOptimize: bool = True
    barnesHutTheta: float = 1.2


@dataclass
class YifanHu:
    stepRatio: float = 0.95
    optimalDistance: float = 100.0
    relativeStrength: float = 0.2
    initialStep: float = 20.0
    barnesHutTheta: float = 1.2


@dataclass
class Noverlap:
    speed: float = 3.0
    ratio: float = 1.2
    margin: float = 5.0


@dataclass
class LabelAdjust:
    speed: float = 1.0
    adjustBySize: bool = True


DESCRIPTIONS = {
    "radius": "distance of the nodes from the centre",
    "size": "side of the square in which nodes are placed",
    "seed": "another number gives other places",
    "area": "the area that nodes share, which gives their ideal distance",
    "gravity": "strength of the pull to the centre",
    "speed": "how far nodes go in a round",
    "scalingRatio": "strength of the repulsion",
    "linLogMode": "attraction by the logarithm of the distance",
    "strongGravityMode": "a pull to the centre that grows with the distance",
    "edgeWeightInfluence": "the power of an edge's weight in its attraction",
    "jitterTolerance": "how much swinging is allowed for speed",
    "outboundAttractionDistribution": "attraction divided by the degree of the source",
    "adjustSizes": "attraction and repulsion from border to border of the nodes",
    "barnesHutOptimize": "repulsion by a tree of cells where there are many nodes",
    "barnesHutTheta": "a cell is one body where its width is under this share of its distance",
    "stepRatio": "how much shorter each step is than the one before",
    "optimalDistance": "length of an edge at rest",
    "relativeStrength": "repulsion against attraction",
    "initialStep": "length of the first step",
    "ratio": "factor of a node's size",
    "margin": "space between nodes",
    "adjustBySize": "label widths follow node sizes",
}
LAYOUTS = {"Circular": Circular, "Random Layout": RandomLayout, "Fruchterman Reingold": FruchtermanReingold, "ForceAtlas 2": ForceAtlas2, "Yifan Hu": YifanHu, "Noverlap": Noverlap, "Label Adjust": LabelAdjust}


def _plain(text: str) -> str:
    return text.lower().replace(" ", "").replace("-", "").replace("_", "")


def find_layout(algorithm: str) -> str:
    for name in LAYOUTS:
        if _plain(algorithm) in _plain(name):
            return name
    raise GraphError(f"layout not found: {algorithm}")


def available_layouts() -> list[str]:
    return list(LAYOUTS)


def layout_properties(algorithm: str) -> list[dict]:
    kind = LAYOUTS[find_layout(algorithm)]
    return [{"name": f.name, "display_name": f.name, "type": f.type, "value": f.default, "description": DESCRIPTIONS[f.name]} for f in fields(kind)]


def _configured(name: str, properties: dict | None):
    config = LAYOUTS[name]()
    known = {_plain(f.name): f for f in fields(config)}
    for key, value in (properties or {}).items():
        f = known.get(_plain(key.rsplit(".", 1)[-1]))
        if f is not None and value is not None:
            kind = type(f.default)
            setattr(config, f.name, str(value).lower() == "true" if kind is bool else kind(float(value)))
    return config


def _set(graph: Graph, xy: DataFrame) -> Graph:
    moved = xy.select(F.col("id").alias("__id"), F.col("x").cast("float").alias("__x"), F.col("y").cast("float").alias("__y"))
    joined = graph.nodes.join(moved, F.col("id") == F.col("__id"), "left")
    return graph.with_(nodes=joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in ("x", "y") else F.col(f"`{c}`") for c in graph.nodes.columns]))


def take_positions(graph: Graph, placed: Graph) -> Graph:
    """``graph`` with the positions that its nodes have in ``placed``."""
    return _set(graph, placed.nodes.select("id", "x", "y"))


def circular(graph: Graph, config: Circular) -> Graph:
    """Nodes in their order around a circle, beginning at the right."""
    placed = with_seq(graph.nodes.select("id", F.col("seq").alias("s")), "s", "id")
    n = max(1, placed.count())
    angle = F.col("seq") * (2 * math.pi / n)
    return _set(graph, placed.select("id", (F.cos(angle) * config.radius).alias("x"), (F.sin(angle) * config.radius).alias("y")))


def random_layout(graph: Graph, config: RandomLayout) -> Graph:
    half = config.size / 1000.0
    seeded = F.concat_ws("/", "id", F.lit(str(config.seed)))
    return _set(graph, graph.nodes.select("id", (start_position(seeded, "x") * half).alias("x"), (start_position(seeded, "y") * half).alias("y")))


def levels_above(below: np.ndarray) -> list[np.ndarray]:
    """Levels of (i, j, mass, x, y, size, nodes), each with cells of four of the level below, from a single cell down to ``below``."""
    levels = [below]
    while len(levels[0]) > 1 or levels[0][:, :2].any():
        below = levels[0]
        keys, at = np.unique(below[:, :2] // 2, axis=0, return_inverse=True)
        at = at.ravel()
        mass = np.bincount(at, below[:, 2])
        levels.insert(0, np.column_stack((keys, mass, *(np.bincount(at, below[:, 2] * below[:, c]) / mass for c in (3, 4, 5)), np.bincount(at, below[:, 6]))))
    return levels


def _bodies(state: DataFrame, n: int) -> tuple[list[np.ndarray], float]:
    """The levels of the tree and the width of its first cell; one level of all nodes where the sum is exact.

    At most ``EXACT_NODES`` or ``MAX_CELLS`` rows come to the driver.
    """
    if n <= EXACT_NODES:
        rows = state.select("mass", "x", "y", "size").toPandas().to_numpy(float)
        return [np.column_stack((np.zeros((len(rows), 2)), rows, np.ones(len(rows))))], 0.0
    lo_x, hi_x, lo_y, hi_y = state.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    depth = 12 if n <= MAX_CELLS else 8
    width, side = max(hi_x - lo_x, hi_y - lo_y, 1e-9), 1 << depth
    cell = lambda c, lo: F.least(F.floor((F.col(c) - lo) / width * side), F.lit(side - 1))
    m = F.sum("mass")
    cells = state.groupBy(cell("x", lo_x).alias("i"), cell("y", lo_y).alias("j")).agg(m.alias("m"), (F.sum(F.col("x") * F.col("mass")) / m).alias("x"), (F.sum(F.col("y") * F.col("mass")) / m).alias("y"), (F.sum(F.col("size") * F.col("mass")) / m).alias("s"), F.count("*").alias("c"))
    levels = levels_above(cells.select("i", "j", "m", "x", "y", "s", "c").toPandas().to_numpy(float))
    return levels, width / side * (1 << (len(levels) - 1))


def _push(levels: list[np.ndarray], width: float, theta: float, force, sizes: bool):
    """Adds the push of all bodies on each node; a node is not pushed by what lies exactly on it."""

    def pushes(x, y, mass, size, cells):
        dx, dy = x - cells[:, 3], y - cells[:, 4]
        d = np.sqrt(dx * dx + dy * dy)
        gap = np.maximum(d - (size + cells[:, 5]) / 2, 1e-1) if sizes else d
        f = np.where(d < 1e-9, 0.0, force(np.maximum(gap, 1e-2), mass, cells[:, 2]) / np.maximum(d, 1e-2))
        return dx * f, dy * f

    parts = []  # for each level but the last: the cells of the next one in the order of those they are parts of, and how many each has
    for cells, below in zip(levels, levels[1:], strict=False):
        place = {(i, j): k for k, (i, j) in enumerate(cells[:, :2].astype(int).tolist())}
        above = np.array([place[i // 2, j // 2] for i, j in below[:, :2].astype(int).tolist()])
        count = np.bincount(above, minlength=len(cells))
        parts.append((np.argsort(above, kind="stable"), np.cumsum(count) - count, count))

    def run(batches):
        for pdf in batches:
            x, y, mass, size = (pdf[c].to_numpy(float) for c in ("x", "y", "mass", "size"))
            px, py = np.zeros(len(x)), np.zeros(len(x))
            for a in range(0, len(x), 512):  # pairs of some nodes and the bodies of a level, at most 2 M at once
                part = slice(a, min(a + 512, len(x)))
                who = np.arange(part.start, part.stop)
                cells = levels[0]
                node, body = np.repeat(who, len(cells)), np.tile(np.arange(len(cells)), len(who))
                for depth, cells in enumerate(levels):
                    dx, dy = x[node] - cells[body, 3], y[node] - cells[body, 4]
                    last = depth == len(levels) - 1
                    whole = (cells[body, 6] == 1) | last | (width / (1 << depth) < theta * np.sqrt(dx * dx + dy * dy))
                    n, b = node[whole], body[whole]
                    fx, fy = pushes(x[n], y[n], mass[n], size[n], cells[b])
                    px += np.bincount(n, fx, len(x))
                    py += np.bincount(n, fy, len(x))
                    if not last:
                        order, first, count = parts[depth]
                        n, b = node[~whole], body[~whole]
                        size_of = count[b]
                        node = np.repeat(n, size_of)
                        body = order[np.repeat(first[b] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())]
            yield pdf.assign(px=px, py=py)

    return run


class _Steps:
    """Lengths of steps that follow the energy (Hu 2005): shorter when it rises, longer after five falls in a row; at rest when no node goes further than ``least``."""

    def __init__(self, first: float, ratio: float, least: float):
        self.now, self.ratio, self.least, self.energy, self.falls = first, ratio, least, math.inf, 0

    def told(self, energy: float) -> None:
        self.falls = self.falls + 1 if energy < self.energy else 0
        if not self.falls:
            self.now *= self.ratio
        elif self.falls >= 5:
            self.falls, self.now = 0, self.now / self.ratio
        self.energy = energy


def _forces(
    graph: Graph, iterations: int, attract, repel, gravity: float, stop, *, cool=None, steps: _Steps | None = None, jitter: float = 1.0, weight: float = 0.0, mass=None, strong: bool = False, theta: float = 1.2, tree: bool = True, by_source: bool = False, sizes: bool = False
) -> Graph:
    """Rounds of pushes, pulls along edges and a pull to the centre.

    With ``cool``, ``cool(i)`` bounds a node's way in round i; with ``steps`` its present length does, and the rounds end when the nodes are at rest.  Without both nodes have speeds of their own (Jacomy et al. 2014): a node
    that swings, whose force turns from round to round, slows down, and the speed of all follows the ratio of traction to swinging.
    """
    d = degrees(graph).select("id", (F.col("degree") + 1.0).alias("mass"))
    start = graph.nodes.select("id", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("x", "y", "size")])
    if isinstance(mass, str):
        start = start.join(graph.nodes.select("id", F.col(mass).cast("double").alias("mass")), "id")
    else:
        start = start.join(d, "id") if mass is None else start.withColumn("mass", F.lit(mass))
    state = durable(start.select("id", "x", "y", "size", "mass", F.lit(0.0).alias("fx0"), F.lit(0.0).alias("fy0")))
    n = state.count()
    if not tree and n > EXACT_NODES:
        raise GraphError(f"an exact sum of repulsions is only for graphs of at most {EXACT_NODES} nodes")
    links = durable(graph.edges.where("source <> target").select(F.col("source").alias("s"), F.col("target").alias("t"), F.pow(F.greatest("weight", F.lit(0.0)), F.lit(weight)).alias("w")))
    schema = "id string, x double, y double, size double, mass double, fx0 double, fy0 double, px double, py double"
    speed = 1.0
    for i in range(iterations if n else 0):
        if stop():
            break
        pushed = state.mapInPandas(_push(*_bodies(state, n), theta, repel, sizes), schema)
        at = state.select("id", "x", "y", "size", "mass")
        e = links.join(at.toDF("s", "sx", "sy", "ss", "sm"), "s").join(at.toDF("t", "tx", "ty", "ts", "tm"), "t")
        dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
        dist = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-2))
        gap = F.greatest(dist - (F.col("ss") + F.col("ts")) / 2, F.lit(0.0)) if sizes else dist
        pull = attract(gap) * F.col("w") / (F.col("sm") if by_source else F.lit(1.0))
        e = e.select("s", "t", (dx / dist * pull).alias("fx"), (dy / dist * pull).alias("fy"))
        pulls = e.select(F.col("s").alias("id"), "fx", "fy").unionByName(e.select(F.col("t").alias("id"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy"))).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        r = F.greatest(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), F.lit(1e-2))
        g = F.lit(gravity) * F.col("mass") * (F.lit(1.0) if strong else 1.0 / r)
        fx = F.col("px") + F.coalesce("fx", F.lit(0.0)) - F.col("x") * g
        fy = F.col("py") + F.coalesce("fy", F.lit(0.0)) - F.col("y") * g
        moved = durable(pushed.join(pulls, "id", "left").select("id", "x", "y", "size", "mass", "fx0", "fy0", fx.alias("fx"), fy.alias("fy")))
        length = F.greatest(F.sqrt(F.pow("fx", F.lit(2)) + F.pow("fy", F.lit(2))), F.lit(1e-9))
        rest = False
        if steps is not None:
            energy, furthest = moved.agg(F.sum(length * length), F.max(F.least(length, F.lit(steps.now)))).first()
            factor, rest = F.least(F.lit(1.0), F.lit(steps.now) / length), furthest < steps.least
            steps.told(energy)
        elif cool is not None:
            factor = F.least(F.lit(1.0), F.lit(cool(i)) / length)
        else:
            swing = F.sqrt(F.pow(F.col("fx") - F.col("fx0"), 2) + F.pow(F.col("fy") - F.col("fy0"), 2))
            traction = F.sqrt(F.pow(F.col("fx") + F.col("fx0"), 2) + F.pow(F.col("fy") + F.col("fy0"), 2)) / 2
            total_swing, total_traction = moved.agg(F.sum(F.col("mass") * swing), F.sum(F.col("mass") * traction)).first()
            speed = min(jitter * total_traction / max(total_swing, 1e-9), 1.5 * speed) if i else 0.1
            own = F.lit(speed) / (1.0 + F.lit(speed) * F.sqrt(swing))
            factor = F.least(own, 10.0 / length) if sizes else own
        state = moved.select("id", (F.col("x") + F.col("fx") * factor).alias("x"), (F.col("y") + F.col("fy") * factor).alias("y"), "size", "mass", F.col("fx").alias("fx0"), F.col("fy").alias("fy0"))
        if rest:
            break
    return _set(graph, state)


def matched(links: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, group): nodes of the (s, t, w) links, there in both directions, in groups by heavy edges; a group has the least name of its first two nodes.

    An edge that is the heaviest at both of its ends, by a hash among equals, makes a pair; so all such edges are found at once, without locks, in a minimum by
    node and a join.  After some rounds nodes without a partner go with the neighbour of their heaviest edge into a pair: stars shrink, too.
    """
    links = durable(links.withColumn("h", F.xxhash64(F.least("s", "t"), F.greatest("s", "t"))))
    left, found = links, None
    for _ in range(rounds):
        best = left.groupBy("s").agg(F.max(F.struct("w", "h", "t")).alias("b")).select("s", F.col("b.t").alias("t"))
        met = durable(best.join(best.select(F.col("s").alias("t"), F.col("t").alias("s")), ["s", "t"]).select(F.col("s").alias("id"), F.least("s", "t").alias("group")))
        found = met if found is None else found.unionByName(met)
        left = durable(left.join(met.select(F.col("id").alias("s")), "s", "left_anti").join(met.select(F.col("id").alias("t")), "t", "left_anti").select("s", "t", "w", "h"))
        if left.isEmpty():
            break
    alone = links.join(found.select(F.col("id").alias("s")), "s", "left_anti").join(found.select(F.col("id").alias("t"), "group"), "t")
    return found.unionByName(alone.groupBy(F.col("s").alias("id")).agg(F.max(F.struct("w", "h", "group"))["group"].alias("group")))


def yifan_hu(graph: Graph, c: YifanHu, iterations: int, stop, smallest: int = 50, wider: float = math.sqrt(7 / 4)) -> Graph:
    """Coarse graphs first (Hu 2005): heavy edges are contracted until ``smallest`` nodes are left, or a level has over 0.8 of the nodes below it.

    The coarsest graph starts from repeatable places, each finer one from those of its groups, with edges at rest shorter by ``wider``; the last step of all is
    the graph itself.  Each level ends when its nodes are at rest (no way over a thousandth of an edge), or after half of the rounds that are left; the graph itself may use all of them.
    """
    edges = graph.edges.where("source <> target").select(F.col("source").alias("s"), F.col("target").alias("t"), "weight")
    links = edges.unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t"), "weight")).groupBy("s", "t").agg(F.sum("weight").alias("w"))
    nodes, n = graph.nodes.select("id", F.lit(1.0).alias("mass")), graph.nodes.count()
    levels, groups = [], []
    while n > smallest:
        links = durable(links)
        if links.isEmpty():
            break
        group = durable(nodes.select("id").join(matched(links), "id", "left").select("id", F.coalesce("group", "id").alias("group")))
        coarse = durable(nodes.join(group, "id").groupBy(F.col("group").alias("id")).agg(F.sum("mass").alias("mass")))
        before, n = n, coarse.count()
        if n > 0.8 * before:
            break
        a, b = group.toDF("s", "gs"), group.toDF("t", "gt")
        links = durable(links.join(a, "s").join(b, "t").where("gs <> gt").groupBy(F.col("gs").alias("s"), F.col("gt").alias("t")).agg(F.sum("w").alias("w")))
        nodes = coarse
        levels.append((nodes, links))
        groups.append(group)
    left, taken, places = iterations, [0], None

    def settle(g: Graph, k: float, rounds: int, mass) -> Graph:
        def counted():
            if not stop():
                taken[0] += 1
            return stop()

        return _forces(g, rounds, lambda d: d * d / k, lambda d, m, cell: c.relativeStrength * k * k * cell / d, 0.0, counted, steps=_Steps(c.initialStep * k / c.optimalDistance, c.stepRatio, k / 1000), mass=mass, theta=c.barnesHutTheta)

    for depth in range(len(levels), 0, -1):
        nodes, links = levels[depth - 1]
        k = c.optimalDistance * wider**depth
        at = nodes.select("id", "mass", F.lit(0).cast("long").alias("seq"), start_position(F.col("id"), "x").alias("x"), start_position(F.col("id"), "y").alias("y"))
        if places is not None:
            at = _spread_out(at.drop("x", "y"), groups[depth], places, k)
        g = Graph(node_frame(at), edge_frame(links.where("s < t").select(F.lit(0).cast("long").alias("seq"), F.col("s").alias("source"), F.col("t").alias("target"), F.col("w").alias("weight"))))
        taken[0] = 0
        places = durable(settle(g.checkpoint(), k, max(1, left // 2), "mass").nodes.select("id", "x", "y"))
        left = max(1, left - taken[0])
    if places is not None:
        graph = _set(graph, _spread_out(graph.nodes.select("id"), groups[0], places, c.optimalDistance)).checkpoint()
    return settle(graph, c.optimalDistance, left, 1.0)


def _spread_out(nodes: DataFrame, group: DataFrame, places: DataFrame, k: float) -> DataFrame:
    """``nodes`` with the places of their groups, each moved by up to a tenth of an edge so that none lie on each other."""
    moved = nodes.join(group, "id").join(places.toDF("group", "gx", "gy"), "group").drop("group")
    return moved.withColumns({a: (F.col(f"g{a}") + start_position(F.col("id"), a) * (k / 5000)).cast("float") for a in ("x", "y")}).drop("gx", "gy")


def _overlaps(state: DataFrame) -> DataFrame:
    """(id, x, y, w, o, ox, oy, ow): for each node (id, x, y, w) all others that are nearer than both half widths, found from both sides.

    Nodes are dealt to grids by their own widths, a power of two each.  A node looks into the nine squares around it in its own grid only, where all
    nodes as wide or narrower have entered their square.  So one very wide node has nine squares to look into, and does not widen the squares of all others.
    """
    level = F.ceil(F.log2(F.greatest("w", F.lit(1e-9)))).cast("int")
    own = state.withColumn("level", level)
    levels = [r[0] for r in own.select("level").distinct().collect()]  # at most one for each power of two
    side = F.pow(F.lit(2.0), F.col("at") + 1)
    entered = own.withColumn("at", F.explode(F.array(*map(F.lit, sorted(levels))))).where("at >= level").withColumns({"i": F.floor(F.col("x") / side), "j": F.floor(F.col("y") / side)})
    around = F.explode(F.array(*[F.struct((F.floor(F.col("x") / side) + a).alias("i"), (F.floor(F.col("y") / side) + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    other = own.withColumn("at", F.col("level")).select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("w").alias("ow"), "at", around.alias("c")).select("o", "ox", "oy", "ow", "at", F.col("c.i").alias("i"), F.col("c.j").alias("j"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    pairs = entered.join(other, ["at", "i", "j"]).where("id <> o").where(F.sqrt(dx * dx + dy * dy) < F.col("w") + F.col("ow"))
    # Nodes of one grid find each other; a wider one is found from the narrower one's side only.
    there, back = ["id", "x", "y", "w", "o", "ox", "oy", "ow"], ["o", "ox", "oy", "ow", "id", "x", "y", "w"]
    both = F.when(F.col("at") == F.col("level"), F.array(F.struct(*there))).otherwise(F.array(F.struct(*there), F.struct(*[F.col(a).alias(b) for a, b in zip(back, there, strict=True)])))
    return pairs.select(F.explode(both).alias("pair")).select("pair.*")


def _apart(graph: Graph, iterations: int, reach, speed: float, stop) -> Graph:
    """Overlapping nodes step apart, until none overlap."""
    boxes = graph.nodes.select("id", F.coalesce("x", F.lit(0.0)).cast("double").alias("x"), F.coalesce("y", F.lit(0.0)).cast("double").alias("y"), reach.alias("w"))
    state = durable(boxes)
    for _ in range(iterations):
        if stop():
            break
        dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
        dist = F.sqrt(dx * dx + dy * dy)
        away = (F.col("w") + F.col("ow") - dist) / 2.0 * min(1.0, speed)
        turn = F.when(F.col("id") < F.col("o"), 1.0).otherwise(-1.0)
        ux, uy = F.when(dist > 1e-6, dx / dist).otherwise(turn), F.when(dist > 1e-6, dy / dist).otherwise(0.0)
        moves = durable(_overlaps(state).groupBy("id").agg(F.avg(ux * away).alias("mx"), F.avg(uy * away).alias("my")))
        if moves.isEmpty():
            break
        state = durable(state.join(moves, "id", "left").select("id", (F.col("x") + F.coalesce("mx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("my", F.lit(0.0))).alias("y"), "w"))
    return _set(graph, state)


def run_layout(graph: Graph, algorithm: str, iterations: int = 1000, properties: dict | None = None, stop=lambda: False) -> Graph:
    """The graph with new positions; iterations below 1 mean 1000."""
    name = find_layout(algorithm)
    c = _configured(name, properties)
    n = iterations if iterations > 0 else 1000
    if isinstance(c, Circular):
        return circular(graph, c)
    if isinstance(c, RandomLayout):
        return random_layout(graph, c)
    graph = graph.checkpoint()  # every round reads it
    if isinstance(c, Noverlap):
        return _apart(graph, n, F.col("size").cast("double") * c.ratio + c.margin / 2, c.speed / 3, stop)
    if isinstance(c, LabelAdjust):
        width = F.greatest(F.length(F.coalesce("label", "id")) * (F.col("size").cast("double") if c.adjustBySize else F.lit(10.0)) / 4, F.lit(1.0))
        return _apart(graph, n, width, c.speed, stop)
    if isinstance(c, FruchtermanReingold):
        k = math.sqrt(c.area / max(1, graph.nodes.count())) * 10
        return _forces(graph, n, lambda d: d * d / k, lambda d, m, cell: k * k * cell / d, 0.01 * c.gravity, stop, cool=lambda i: max(1.0, c.speed * k * (1 - i / n)), mass=1.0, strong=True)
    if isinstance(c, ForceAtlas2):
        pull = (lambda d: F.log1p(d)) if c.linLogMode else (lambda d: d)
        repel = lambda d, m, cell: c.scalingRatio * m * cell / d
        return _forces(
            graph, n, pull, repel, c.gravity, stop, jitter=c.jitterTolerance, weight=c.edgeWeightInfluence, strong=c.strongGravityMode,
            theta=c.barnesHutTheta, tree=c.barnesHutOptimize, by_source=c.outboundAttractionDistribution, sizes=c.adjustSizes,
        )
    return yifan_hu(graph, c, n, stop)


class LayoutJob:
    """One layout at a time, in a thread of its own; it looks at its stop sign once a round."""

    def __init__(self):
        self.thread, self.name, self.stopped, self.result, self.error = None, None, threading.Event(), None, None

    def running(self) -> bool:
        return self.thread is not None and self.thread.is_alive()

    def start(self, graph: Graph, algorithm: str, iterations: int = 1000, properties: dict | None = None, done=lambda graph: None) -> None:
        if self.running():
            raise GraphError("a layout is running already")
        self.name, self.result, self.error = find_layout(algorithm), None, None
        self.stopped.clear()

        def work():
            try:
                self.result = run_layout(graph, algorithm, iterations, properties, self.stopped.is_set)
                done(self.result)
            except Exception as e:  # shown by status()
                self.error = str(e)

        self.thread = threading.Thread(target=work, daemon=True)
        self.thread.start()

    def stop(self) -> None:
        self.stopped.set()
        if self.thread is not None:
            self.thread.join()

    def status(self) -> dict:
        return {"running": self.running(), "layout": self.name} | ({"error": self.error} if self.error else {})


def settings_of(algorithm: str, properties: dict | None = None) -> dict:
    return asdict(_configured(find_layout(algorithm), properties))


__all__ = ["EXACT_NODES", "LAYOUTS", "LayoutJob", "available_layouts", "find_layout", "layout_properties", "run_layout", "settings_of"]
