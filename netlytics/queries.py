"""Graph queries over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import copurchase, day_steps, event_transitions, trade
from .functions.values import coerce, type_named
from .graph import Graph, degrees
from .operators import appearance as A
from .operators import edit as E
from .operators import filters as FI
from .operators import layout as L
from .operators import paths as PA
from .operators import preview as P
from .operators import query as Q
from .operators import statistics as S
from .operators.components import strong_components as strong_parts
from .operators.rewiring import random_like
from .operators.sampling import sampled_betweenness
from .plans import reports as R
from .sources import tables as IO

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_COPURCHASE = """
e AS (SELECT CAST(a.l_partkey AS BIGINT) AS s, CAST(b.l_partkey AS BIGINT) AS t, CAST(count(*) AS DOUBLE) AS w
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2),
n AS (SELECT DISTINCT s AS id FROM e UNION SELECT t FROM e),
u AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
deg AS (SELECT n.id, CAST(count(*) FILTER (WHERE e.t = n.id) AS INT) AS indegree, CAST(count(*) FILTER (WHERE e.s = n.id) AS INT) AS outdegree,
               CAST(count(*) AS INT) AS degree FROM n JOIN e ON e.s = n.id OR e.t = n.id GROUP BY n.id)"""
_TRADE = """
e AS (SELECT 'N' || c_nationkey AS s, 'N' || s_nationkey AS t, CAST(count(*) AS DOUBLE) AS w, c_nationkey * 1000 + s_nationkey AS seq
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      GROUP BY c_nationkey, s_nationkey),
n AS (SELECT 'N' || n_nationkey AS id, CAST(n_nationkey AS BIGINT) AS seq, n_name AS label, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_COMPONENTS = """
cc(id, l) USING KEY (id) AS (
  SELECT DISTINCT s, s FROM u UNION
  SELECT u.t, min(cc.l) FROM cc JOIN u ON u.s = cc.id JOIN recurring.cc r ON r.id = u.t WHERE cc.l < r.l GROUP BY u.t),
numbered AS (SELECT id, CAST(dense_rank() OVER (ORDER BY l) - 1 AS INT) AS componentnumber FROM cc)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _copurchase(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_COPURCHASE}{', ' + ctes if ctes else ''} {select}"


def _trade(ctes: str, select: str) -> str:
    return f"WITH {_TRADE}{', ' + ctes if ctes else ''} {select}"


# ---------------------------------------------------------------- degrees, counts, pages


@query(_copurchase("", "SELECT CAST(id AS VARCHAR) AS id, indegree, outdegree, degree FROM deg"))
def degree_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(copurchase(spark, sf_dir))


@query(_copurchase("", "SELECT CAST(id AS VARCHAR) AS id, degree FROM deg ORDER BY degree DESC, deg.id LIMIT 10"))
def degree_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = copurchase(spark, sf_dir)
    d = degrees(g).select("id", "degree", F.col("id").cast("long").alias("k"))
    return d.orderBy(F.desc("degree"), "k").limit(10).select("id", "degree")


@query(_copurchase("", "SELECT degree, count(*) AS nodes FROM deg GROUP BY degree"))
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.degree_histogram(copurchase(spark, sf_dir))


@query(_copurchase("", """SELECT nc AS node_count, ec AS edge_count, round(2.0 * ec / (nc * (nc - 1.0)), 9) AS density, round(2.0 * ec / nc, 9) AS average_degree, TRUE AS is_directed
FROM (SELECT count(*) AS nc FROM n), (SELECT count(*) AS ec FROM e)"""))  # fmt: skip
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.graph_stats(copurchase(spark, sf_dir)).withColumns({"density": F.round("density", 9), "average_degree": F.round("average_degree", 9)})


@query("SELECT TRUE AS is_directed, FALSE AS is_undirected, FALSE AS is_mixed")
def graph_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.graph_type(trade(spark, sf_dir))


@query("SELECT * FROM (VALUES ('id', 'String', TRUE), ('label', 'String', TRUE), ('x', 'Float', TRUE), ('y', 'Float', TRUE), ('size', 'Float', TRUE), ('r', 'Integer', TRUE), ('g', 'Integer', TRUE), ('b', 'Integer', TRUE), ('a', 'Integer', TRUE), ('r_name', 'String', FALSE)) t(id, type, property)")
def node_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c["id"], c["type"], c["property"]) for c in Q.columns(trade(spark, sf_dir))], "id string, type string, property boolean")


@query(_copurchase("", "SELECT CAST(deg.id AS VARCHAR) AS id, CAST(deg.id AS VARCHAR) AS label, degree, p_brand FROM deg LEFT JOIN part ON p_partkey = deg.id ORDER BY deg.id LIMIT 50 OFFSET 20"))
def nodes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.query_nodes(copurchase(spark, sf_dir), 50, 20).select("id", "label", "degree", F.get_json_object("attributes", "$.p_brand").alias("p_brand"))


@query(_copurchase("", "SELECT CAST(s AS VARCHAR) AS source, CAST(t AS VARCHAR) AS target, w AS weight, TRUE AS directed FROM e ORDER BY s, t LIMIT 50 OFFSET 20"))
def edges_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.query_edges(copurchase(spark, sf_dir), 50, 20).select("source", "target", "weight", "directed")


# ---------------------------------------------------------------- filters and components


@query(_copurchase("k AS (SELECT id FROM deg WHERE degree BETWEEN 4 AND 8)", "SELECT CAST(s AS VARCHAR) AS source, CAST(t AS VARCHAR) AS target FROM e WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)"))
def filter_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.filter_by_degree(copurchase(spark, sf_dir), 4, 8).edges.select("source", "target")


@query(_trade("", "SELECT s AS source, t AS target, w AS weight FROM e WHERE w BETWEEN 50 AND 120"))
def filter_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.filter_by_edge_weight(trade(spark, sf_dir), 50, 120).edges.select("source", "target", "weight")


@query(_trade("k AS (SELECT * FROM e WHERE w >= 200)", "SELECT id, label FROM n WHERE id IN (SELECT s FROM k UNION SELECT t FROM k)"))
def remove_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.remove_isolates(FI.filter_by_edge_weight(trade(spark, sf_dir), 200)).nodes.select("id", "label")


def _ego_sql(depth: int) -> str:
    steps = ["h0 AS (SELECT min(id) AS id FROM n)"] + [f"h{i} AS (SELECT id FROM h{i - 1} UNION SELECT u.t FROM u JOIN h{i - 1} ON u.s = h{i - 1}.id)" for i in range(1, depth + 1)]
    return _copurchase(", ".join(steps), f"SELECT CAST(s AS VARCHAR) AS source, CAST(t AS VARCHAR) AS target FROM e WHERE s IN (SELECT id FROM h{depth}) AND t IN (SELECT id FROM h{depth})")


def _ego(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    g = copurchase(spark, sf_dir)
    centre = g.nodes.orderBy("seq").first()["id"]
    return FI.ego_network(g, centre, depth).edges.select("source", "target")


@query(_ego_sql(1))
def ego_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ego(spark, sf_dir, 1)


@query(_ego_sql(2))
def ego_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ego(spark, sf_dir, 2)


@query(_copurchase(_COMPONENTS, "SELECT CAST(id AS VARCHAR) AS id, componentnumber FROM numbered", True))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compute_connected_components(copurchase(spark, sf_dir))[0].nodes.select("id", "componentnumber")


@query(_copurchase(_COMPONENTS, "SELECT componentnumber, count(*) AS size FROM numbered GROUP BY componentnumber", True))
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.component_sizes(copurchase(spark, sf_dir))


@query(_copurchase(_COMPONENTS + ", best AS (SELECT componentnumber FROM numbered GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "SELECT CAST(id AS VARCHAR) AS id FROM numbered WHERE componentnumber IN (SELECT componentnumber FROM best)", True))
def giant_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.giant_component(copurchase(spark, sf_dir))[0].nodes.select("id")


# ---------------------------------------------------------------- statistics

_CLUSTERING = """
k AS (SELECT s AS id, count(*) AS k FROM u GROUP BY s),
tri AS (SELECT a.s AS id, count(*) / 2.0 AS t FROM u a JOIN u b ON a.s = b.s AND a.t <> b.t JOIN u c ON c.s = a.t AND c.t = b.t GROUP BY a.s),
cl AS (SELECT k.id, CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1.0)) ELSE 0.0 END AS clustering FROM k LEFT JOIN tri ON tri.id = k.id)"""


@query(_copurchase(_CLUSTERING, "SELECT CAST(id AS VARCHAR) AS id, CAST(round(clustering, 9) AS DOUBLE) AS clustering FROM cl"))
def clustering_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clustering(copurchase(spark, sf_dir)).withColumn("clustering", F.round("clustering", 9))


@query(_copurchase(_CLUSTERING, "SELECT round(avg(clustering), 9) AS average_clustering FROM cl"))
def average_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clustering(copurchase(spark, sf_dir)).agg(F.round(F.avg("clustering"), 9).alias("average_clustering"))


@query(_copurchase(_CLUSTERING, "SELECT CAST(coalesce(sum(t), 0) / 3 AS BIGINT) AS triangles FROM tri"))
def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.triangles(copurchase(spark, sf_dir)).agg((F.coalesce(F.sum("t"), F.lit(0)) / 3).cast("long").alias("triangles"))


@query(_copurchase("""
k AS (SELECT count(*) AS k FROM n), o AS (SELECT s, count(*) AS d FROM e GROUP BY s),
pr(it, id, r) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT k FROM k) FROM n UNION ALL
  SELECT m.it + 1, n.id, 0.15 / k.k + 0.85 * (coalesce(i.x, 0) + m.dm / k.k) FROM n CROSS JOIN k
  CROSS JOIN (SELECT max(pr.it) AS it, coalesce(sum(pr.r) FILTER (WHERE o.d IS NULL), 0) AS dm FROM pr LEFT JOIN o ON o.s = pr.id) m
  LEFT JOIN (SELECT e.t, sum(pr.r / o.d) AS x FROM pr JOIN e ON e.s = pr.id JOIN o ON o.s = e.s GROUP BY e.t) i ON i.t = n.id
  WHERE m.it < 20)""", "SELECT CAST(id AS VARCHAR) AS id, round(r, 10) AS pageranks FROM pr WHERE it = 20", True))  # fmt: skip
def pagerank_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pagerank(copurchase(spark, sf_dir), rounds=20, tolerance=0).withColumn("pageranks", F.round("pageranks", 10))


def _hits_sql(rounds: int) -> str:
    steps = ["h0 AS (SELECT id, 1.0::DOUBLE AS h FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"ra{i} AS (SELECT n.id, coalesce(sum(h.h), 0.0) AS a FROM n LEFT JOIN e ON e.t = n.id LEFT JOIN h{i - 1} h ON h.id = e.s GROUP BY n.id)")
        steps.append(f"rh{i} AS (SELECT n.id, coalesce(sum(a.a), 0.0) AS h FROM n LEFT JOIN e ON e.s = n.id LEFT JOIN ra{i} a ON a.id = e.t GROUP BY n.id)")
        steps.append(f"h{i} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM rh{i}) AS h FROM rh{i})")
    last = f"SELECT CAST(a.id AS VARCHAR) AS id, round(a / (SELECT sqrt(sum(a * a)) FROM ra{rounds}), 8) AS \"Authority\", round(h, 8) AS \"Hub\" FROM ra{rounds} a JOIN h{rounds} h ON h.id = a.id"
    return _copurchase(", ".join(steps), last)


@query(_hits_sql(5))
def hits_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hits(copurchase(spark, sf_dir), rounds=5, tolerance=0).select("id", F.round("Authority", 8).alias("Authority"), F.round("Hub", 8).alias("Hub"))


@query(_hits_sql(10))
def hits_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hits(copurchase(spark, sf_dir), rounds=10, tolerance=0).select("id", F.round("Authority", 8).alias("Authority"), F.round("Hub", 8).alias("Hub"))


def _eigen_sql(rounds: int, of=_trade, name: str = "id") -> str:
    steps = ["v0 AS (SELECT id, 1.0::DOUBLE AS v FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS (SELECT n.id, n.v + coalesce(sum(p.v), 0.0) AS v FROM v{i - 1} n LEFT JOIN e ON e.t = n.id LEFT JOIN v{i - 1} p ON p.id = e.s GROUP BY n.id, n.v)")
        steps.append(f"v{i} AS MATERIALIZED (SELECT id, v / (SELECT max(v) FROM r{i}) AS v FROM r{i})")
    return of(", ".join(steps), f"SELECT {name}, round(v, 8) AS eigencentrality FROM v{rounds}")


@query(_eigen_sql(8))
def eigenvector_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.eigenvector(trade(spark, sf_dir), rounds=8).withColumn("eigencentrality", F.round("eigencentrality", 8))


@query(_eigen_sql(20, _copurchase, "CAST(id AS VARCHAR) AS id"))
def eigen_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.eigenvector(copurchase(spark, sf_dir), rounds=20).withColumn("eigencentrality", F.round("eigencentrality", 8))


_PAIRS = """
k AS (SELECT count(*) AS k FROM n),
b(src, id, d, sg) USING KEY (src, id) AS (SELECT id, id, 0, 1::DOUBLE FROM n UNION
  SELECT b.src, u.t, b.d + 1, sum(b.sg) FROM b JOIN u ON u.s = b.id
  LEFT JOIN recurring.b r ON r.id = u.t AND r.src = b.src WHERE r.id IS NULL GROUP BY 1, 2, 3)"""


@query(_copurchase(_PAIRS + """,
back(src, id, d, sg, delta) AS (SELECT src, id, d, sg, 0::DOUBLE FROM b WHERE d = (SELECT max(d) FROM b) UNION ALL
  SELECT v.src, v.id, v.d, v.sg, coalesce(sum(v.sg / f.sg * (1 + f.delta)), 0) FROM b v JOIN (SELECT max(d) - 1 AS d FROM back) x ON v.d = x.d
  LEFT JOIN (SELECT back.src, u.t AS id, back.sg, back.delta FROM back JOIN u ON u.s = back.id) f ON f.src = v.src AND f.id = v.id GROUP BY 1, 2, 3, 4)""", """
SELECT CAST(id AS VARCHAR) AS id, round(sum(CASE WHEN d > 0 THEN delta ELSE 0 END) / 2 / ((max(k) - 1.0) * (max(k) - 2.0) / 2), 9) AS betweenesscentrality FROM back CROSS JOIN k GROUP BY id""", True))  # fmt: skip
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distances(copurchase(spark, sf_dir).checkpoint())[0].select("id", F.round("betweenesscentrality", 9).alias("betweenesscentrality"))


@query(_copurchase(_PAIRS, """SELECT CAST(src AS VARCHAR) AS id, round(count(*) / sum(d)::DOUBLE, 9) AS closnesscentrality, round(sum(1.0::DOUBLE / d) / (max(k) - 1), 9) AS harmonicclosnesscentrality,
CAST(max(d) AS DOUBLE) AS eccentricity FROM b CROSS JOIN k WHERE d > 0 GROUP BY src""", True))  # fmt: skip
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.distances(copurchase(spark, sf_dir).checkpoint())[0]
    return d.select("id", F.round("closnesscentrality", 9).alias("closnesscentrality"), F.round("harmonicclosnesscentrality", 9).alias("harmonicclosnesscentrality"), "eccentricity")


@query(_copurchase(_PAIRS, """SELECT round(sum(d) / count(*)::DOUBLE, 9) AS average_path_length, CAST(max(d) AS BIGINT) AS diameter,
(SELECT CAST(min(m) AS BIGINT) FROM (SELECT max(d) AS m FROM b WHERE d > 0 GROUP BY src)) AS radius FROM b WHERE d > 0""", True))  # fmt: skip
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    scalars = S.distances(copurchase(spark, sf_dir).checkpoint(), shares=False)[1]
    return spark.createDataFrame([(round(scalars["average_path_length"], 9), scalars["diameter"], scalars["radius"])], "average_path_length double, diameter long, radius long")


@query(_copurchase("", "SELECT count(*) AS nodes, TRUE AS closeness, TRUE AS harmonic, TRUE AS path_length, TRUE AS reached FROM n"))
def closeness_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched distances beside exact ones: mean errors under 2 %, hardly any node off by over 5 %."""
    g = copurchase(spark, sf_dir).checkpoint()
    found, about = PA.sketched_distances(g)
    exact, scalars = S.distances(g, shares=False)
    both = found.join(exact.select("id", F.col("closnesscentrality").alias("c"), F.col("harmonicclosnesscentrality").alias("h")), "id")
    error = lambda a, b: F.abs(F.col(a) / F.col(b) - 1)
    row = both.agg(F.count("*"), F.avg(error("closnesscentrality", "c")), F.avg(error("harmonicclosnesscentrality", "h")), F.avg((error("harmonicclosnesscentrality", "h") > 0.05).cast("int")), F.min("reached")).first()
    length = abs(about["average_path_length"] / scalars["average_path_length"] - 1)
    return spark.createDataFrame([(row[0], row[1] < 0.02, row[2] < 0.02, length < 0.02, row[3] < 0.02 and row[4] > 0)], "nodes long, closeness boolean, harmonic boolean, path_length boolean, reached boolean")


@query(_copurchase(_PAIRS, """SELECT CAST(max(d) AS BIGINT) AS diameter, (SELECT CAST(min(m) AS BIGINT) FROM (SELECT max(d) AS m FROM b WHERE d > 0 GROUP BY src)) AS radius FROM b WHERE d > 0""", True))
def path_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PA.path_bounds(copurchase(spark, sf_dir).checkpoint())
    return spark.createDataFrame([(found["diameter"], found["radius"])], "diameter long, radius long")


@query("""WITH RECURSIVE steps AS (
  SELECT event_type || ':' || CAST(floor(value * 10) AS BIGINT) AS s,
         lead(event_type || ':' || CAST(floor(value * 10) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS t
  FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
e AS MATERIALIZED (SELECT DISTINCT s, t FROM steps WHERE t IS NOT NULL),
n AS (SELECT s AS id FROM e UNION SELECT t FROM e),
reach AS (SELECT id, id AS other FROM n UNION SELECT r.id, e.t FROM reach r JOIN e ON e.s = r.other)
SELECT a.id, min(a.other) AS component FROM reach a JOIN reach b ON a.id = b.other AND a.other = b.id GROUP BY a.id""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_parts(day_steps(spark, sf_dir).checkpoint())


_BY_BRAND = """
m AS (SELECT p_partkey AS id, p_brand AS community FROM part), ec AS (SELECT a.community AS cs, b.community AS ct FROM e JOIN m a ON a.id = e.s JOIN m b ON b.id = e.t)"""


def _brands(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.col("p_brand").alias("community"))


@query(_copurchase(_BY_BRAND + ", k AS (SELECT c, count(*) AS k FROM (SELECT cs AS c FROM ec UNION ALL SELECT ct FROM ec) GROUP BY c)", """
SELECT round((SELECT count(*) FROM ec WHERE cs = ct) / (SELECT count(*) FROM ec)::DOUBLE - (SELECT sum((k / (2.0 * (SELECT count(*) FROM ec))) ^ 2) FROM k), 9) AS modularity"""))  # fmt: skip
def modularity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = copurchase(spark, sf_dir)
    return S.modularity_score(g, _brands(g)).select(F.round("modularity", 9).alias("modularity"))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compute_modularity(copurchase(spark, sf_dir).checkpoint())[0].nodes.select("id", "modularity_class")


# ---------------------------------------------------------------- appearance

_SHADES = "shade AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(A.PALETTE)) + ") t(i, r, g, b))"


@query(_copurchase(_SHADES + """,
v AS (SELECT n.id, p_brand FROM n JOIN part ON p_partkey = n.id), f AS (SELECT p_brand, row_number() OVER (ORDER BY min(id)) - 1 AS i FROM v GROUP BY p_brand)""",
"SELECT CAST(v.id AS VARCHAR) AS id, r, g, b FROM v JOIN f USING (p_brand) JOIN shade ON shade.i = f.i % 12"))
def color_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.color_by_partition(copurchase(spark, sf_dir), "p_brand")[0].nodes.select("id", "r", "g", "b")


@query(_trade("", "SELECT id, CASE r_name WHEN 'ASIA' THEN 10 ELSE 153 END AS r, CASE r_name WHEN 'ASIA' THEN 20 ELSE 153 END AS g, CASE r_name WHEN 'ASIA' THEN 30 ELSE 153 END AS b FROM n"))
def color_by_partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.color_by_partition(trade(spark, sf_dir), "r_name", {"ASIA": [10, 20, 30]})[0].nodes.select("id", "r", "g", "b")


_RANKED = "v AS (SELECT n.id, p_retailprice AS p FROM n JOIN part ON p_partkey = n.id), m AS (SELECT min(p) AS lo, max(p) AS hi FROM v)"


@query(_copurchase(_RANKED, "SELECT CAST(id AS VARCHAR) AS id, 255 AS r, CAST(trunc(255.0 + (p - lo) / (hi - lo) * -255.0) AS INT) AS g, CAST(trunc(200.0 + (p - lo) / (hi - lo) * -200.0) AS INT) AS b FROM v, m"))
def color_by_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.color_by_ranking(copurchase(spark, sf_dir), "p_retailprice").nodes.select("id", "r", "g", "b")


@query(_copurchase(_RANKED, "SELECT CAST(id AS VARCHAR) AS id, round(CAST(CAST(5.0 + (p - lo) / (hi - lo) * 45.0 AS FLOAT) AS DOUBLE), 4) AS size FROM v, m"))
def size_by_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.size_by_ranking(copurchase(spark, sf_dir), "p_retailprice").nodes.select("id", F.round(F.col("size").cast("double"), 4).alias("size"))


@query(_trade("m AS (SELECT min(w) AS lo, max(w) AS hi FROM e)", "SELECT CAST(seq AS BIGINT) AS seq, round(1.0 + (w - lo) / (hi - lo) * 4.0, 9) AS thickness FROM e, m"))
def edge_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.edge_thickness(A.edge_thickness_by_weight(trade(spark, sf_dir), 1.0, 5.0)).withColumn("thickness", F.round("thickness", 9))


@query(_trade("", "SELECT s AS source, t AS target, CASE r_name WHEN 'ASIA' THEN 10 ELSE 153 END AS r FROM e JOIN n ON n.id = e.s"))
def color_edges_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.color_by_partition(trade(spark, sf_dir), "r_name", {"ASIA": [10, 20, 30]})[0]
    return P.set_preview_settings(g, {"edge.color": "source"})[0].edges.select("source", "target", "r")


# ---------------------------------------------------------------- edits


@query(_trade("", "SELECT id, CAST(CASE id WHEN 'N1' THEN 3.5 WHEN 'N2' THEN 7 END AS FLOAT) AS x FROM n WHERE id IN ('N1', 'N2')"))
def batch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = E.batch_set_positions(trade(spark, sf_dir), [{"id": "N1", "x": 1, "y": 1}, {"id": "N2", "x": 7, "y": 8}, {"id": "N1", "x": 3.5, "y": 2}, {"id": "zz", "x": 0, "y": 0}])
    return g.nodes.where("id IN ('N1', 'N2')").select("id", "x")


@query(_trade("", "SELECT id, CASE id WHEN 'N1' THEN 5 WHEN 'N3' THEN 12 END AS score, CASE id WHEN 'N1' THEN 'b' END AS tag FROM n"))
def batch_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = E.set_attributes(trade(spark, sf_dir), [{"id": "N1", "attributes": {"score": 4, "tag": "a"}}, {"id": "N1", "attributes": {"score": 5, "tag": "b"}}, {"id": "N3", "attributes": {"score": "12.7"}}])
    return g.nodes.select("id", "score", "tag")


@query(_trade("", "SELECT id, CASE id WHEN 'N0' THEN 1 ELSE 153 END AS r, CASE id WHEN 'N0' THEN 4 ELSE 255 END AS a FROM n"))
def batch_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = E.batch_set_node_colors(trade(spark, sf_dir), [{"id": "N0", "r": 1, "g": 2, "b": 3, "a": 4}])
    return g.nodes.select("id", "r", "a")


@query(_trade("", "SELECT id, label FROM n UNION ALL VALUES ('new', 'first'), ('other', 'other'), ('bare', NULL)"))
def add_nodes_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = [{"id": "new", "label": "first"}, {"id": "new", "label": "second"}, {"id": "N1", "label": "x"}, {"id": None}, {"id": "other"}, {"id": "bare", "label": None}]
    return E.add_nodes(trade(spark, sf_dir), batch)[0].nodes.select("id", "label")


@query(_trade("k AS (SELECT s, t, w FROM e WHERE w >= 100)", "SELECT s AS source, t AS target, w AS weight FROM k UNION ALL SELECT 'N0', 'N0', 2.5 WHERE NOT EXISTS (SELECT 1 FROM k WHERE s = 'N0' AND t = 'N0')"))
def add_edges_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = FI.filter_by_edge_weight(trade(spark, sf_dir), 100)
    batch = [{"source": "N0", "target": "N0", "weight": 2.5}, {"source": "N0", "target": "N0", "weight": 9}, {"source": "N0", "target": "nowhere"}, {"source": None, "target": "N1"}]
    return E.add_edges(g, batch)[0].edges.select("source", "target", "weight")


@query(_trade("", "SELECT s AS source, t AS target FROM e WHERE s NOT IN ('N1', 'N2') AND t NOT IN ('N1', 'N2')"))
def bulk_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bulk_remove_nodes(trade(spark, sf_dir), ["N1", "N2", "N1", "zz"])[0].edges.select("source", "target")


@query("""WITH t AS (
  SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_custkey || '.7' WHEN 1 THEN '-' || c_custkey || '.9' WHEN 2 THEN c_mktsegment WHEN 3 THEN 'TRUE' WHEN 4 THEN CAST(c_custkey * 99999999 AS VARCHAR) ELSE c_custkey || 'e3' END AS v FROM customer),
x AS (SELECT *, TRY_CAST(v AS DOUBLE) AS d FROM t)
SELECT c_custkey, v, CAST(CASE WHEN d >= 2147483647 THEN 2147483647 ELSE trunc(d) END AS INTEGER) AS i, CAST(trunc(d) AS BIGINT) AS l, d, lower(v) = 'true' AS b FROM x""")
def coercion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of the customers' keys and segments, as each type."""
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 6
    v = F.when(kind == 0, F.concat(key, F.lit(".7"))).when(kind == 1, F.concat(F.lit("-"), key, F.lit(".9"))).when(kind == 2, F.col("c_mktsegment")).when(kind == 3, F.lit("TRUE")).when(kind == 4, (F.col("c_custkey") * 99999999).cast("string")).otherwise(F.concat(key, F.lit("e3")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", v.alias("v"))
    kinds = {"i": "integer", "l": "long", "d": "double", "b": "bool"}
    return rows.select("c_custkey", "v", *[coerce(F.col("v"), type_named(k)).alias(c) for c, k in kinds.items()])


@query(_trade("", "SELECT 'Id,Label,r_name' AS line UNION ALL SELECT id || ',' || label || ',' || r_name FROM n"))
def csv_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.csv_lines(trade(spark, sf_dir), ",", "nodes").select("line")


@query(_trade("", "SELECT 'Source;Target;Weight' AS line UNION ALL SELECT s || ';' || t || ';' || CAST(w AS VARCHAR) FROM e"))
def csv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.csv_lines(trade(spark, sf_dir), ";", "edges").select("line")


# ---------------------------------------------------------------- reports

_METRICS = """
md AS (SELECT id, CAST(degree AS DOUBLE) AS degree, CAST(indegree AS DOUBLE) AS indegree FROM deg),
tops AS (SELECT 'degree' AS metric, id, degree AS value, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM md UNION ALL
         SELECT 'indegree', id, indegree, row_number() OVER (ORDER BY indegree DESC, id) FROM md)"""


@query(_copurchase(_METRICS, "SELECT metric, CAST(rank AS INT) AS rank, CAST(id AS VARCHAR) AS id, value FROM tops WHERE rank <= 5"))
def top5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(Q.with_degrees(copurchase(spark, sf_dir)), ["degree", "indegree"], 5, "seq")


@query(_copurchase(_METRICS, "SELECT CAST(id AS VARCHAR) AS id, count(*) AS lists FROM tops WHERE rank <= 10 GROUP BY id HAVING count(*) >= 2"))
def multi_top10_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_overlap(Q.with_degrees(copurchase(spark, sf_dir)), ["degree", "indegree"], 10, 2, "seq")


@query(_copurchase("q AS (SELECT quantile_cont(indegree, 0.5) AS b, quantile_cont(degree, 0.5) AS d FROM deg)", """SELECT CAST(id AS VARCHAR) AS id,
CASE WHEN indegree > b AND degree > d THEN 'critical hub' WHEN indegree > b THEN 'bridge' WHEN degree > d THEN 'local hub' ELSE 'peripheral' END AS role FROM deg, q"""))  # fmt: skip
def role_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.roles(degrees(copurchase(spark, sf_dir)), "indegree", "degree")


@query(_copurchase(_BY_BRAND, "SELECT community, count(*) AS size FROM n JOIN m ON m.id = n.id GROUP BY community"))
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.community_sizes(_brands(copurchase(spark, sf_dir)))


@query(_copurchase(_BY_BRAND, "SELECT cs AS from_community, ct AS to_community, count(*) AS edges FROM ec GROUP BY 1, 2"))
def inter_community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = copurchase(spark, sf_dir)
    return R.community_links(g, _brands(g)).drop("weight")


@query(_copurchase(_CLUSTERING + ", c AS (SELECT avg(clustering) AS c FROM cl), z AS (SELECT count(*) AS nc, (SELECT count(*) FROM e) AS ec FROM n)", """
SELECT round(c, 9) AS clustering, round(2.0 * ec / nc / nc, 9) AS random_clustering, round(ln(nc) / ln(2.0 * ec / nc), 9) AS random_path_length FROM c, z"""))  # fmt: skip
def small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.small_world(copurchase(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("clustering", "random_clustering", "random_path_length")])


@query(_copurchase("h AS (SELECT degree, count(*) AS nodes FROM deg GROUP BY degree)", "SELECT round(regr_slope(ln(nodes), ln(degree)), 8) AS slope, count(*) AS points FROM h"))
def scale_free_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scale_free(copurchase(spark, sf_dir)).select(F.round("slope", 8).alias("slope"), "points")


@query(_copurchase("""
h AS (SELECT degree::DOUBLE AS x, count(*)::DOUBLE AS c FROM deg GROUP BY degree),
tails AS (SELECT a.x, a.c, sum(b.c) AS n, sum(b.c * ln(b.x)) AS logs, sum(b.c * b.x) AS mean, count(*) AS points FROM h a JOIN h b ON b.x >= a.x GROUP BY a.x, a.c),
cuts AS (SELECT x AS cut, n AS total, logs, mean, points, 1 + n / (logs - n * ln(x - 0.5)) AS a FROM tails WHERE points > 1),
fits AS (SELECT cut, a, total, cuts.points, cuts.mean, max(greatest(abs(n / total - ((x - 0.5) / (cut - 0.5)) ^ (1 - a)), abs((n - c) / total - ((x + 0.5) / (cut - 0.5)) ^ (1 - a)))) AS distance
         FROM cuts JOIN tails ON x >= cut GROUP BY cut, a, total, cuts.points, cuts.mean),
best AS (SELECT *, total / (mean - total * (cut - 0.5)) AS rate FROM fits ORDER BY round(distance, 12), cut LIMIT 1),
gains AS (SELECT best.*, c, ln((a - 1) / (cut - 0.5)) - a * ln(x / (cut - 0.5)) - ln(rate) + rate * (x - cut + 0.5) AS g FROM best JOIN h ON x >= cut)""", """
SELECT round(a, 7) AS exponent, CAST(cut AS BIGINT) AS cut_off, round(distance, 7) AS distance, CAST(total AS BIGINT) AS tail_nodes, round(sum(c * g), 5) AS likelihood_ratio,
round(sum(c * g) / sqrt(sum(c * g * g) - sum(c * g) ^ 2 / total), 5) AS vuong FROM gains GROUP BY a, cut, distance, total"""))  # fmt: skip
def power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda c, k: F.round(c, k).alias(c)
    return R.power_law(copurchase(spark, sf_dir)).select(rounded("exponent", 7), F.col("cut_off").cast("long"), rounded("distance", 7), "tail_nodes", rounded("likelihood_ratio", 5), rounded("vuong", 5))


@query(_copurchase("", "SELECT CAST(id AS VARCHAR) AS id, degree, TRUE AS simple FROM deg"))
def rewired_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degrees of a random graph made by edge swaps are those of the co-purchase graph; it has no loops and no edge twice."""
    g = random_like(copurchase(spark, sf_dir), rounds=3).checkpoint()
    wrong = g.edges.groupBy("source", "target").agg(F.count("*").alias("n")).where("n > 1 OR source >= target").limit(1).agg((F.count("*") == 0).alias("simple"))
    return degrees(g).select("id", "degree").join(F.broadcast(wrong))


@query(_copurchase("", "SELECT CAST(id AS VARCHAR) AS id, TRUE AS holds, TRUE AS promised FROM n"))
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled betweenness beside exact one: each node within the error told for it, and that within the error asked for."""
    g = copurchase(spark, sf_dir).checkpoint()
    about, told = sampled_betweenness(g, error=0.05)
    exact = S.distances(g)[0].select("id", F.col("betweenesscentrality").alias("b"))
    off = F.abs(F.col("betweenesscentrality") - F.col("b"))
    return about.join(exact, "id").select("id", (off <= F.col("error")).alias("holds"), (F.col("error") <= told["error"] + 1e-9).alias("promised"))


@query("""WITH t AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)
SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM t WHERE target IS NOT NULL GROUP BY 1, 2""")
def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_transitions(spark, sf_dir)


# ---------------------------------------------------------------- layouts


@query(_trade("k AS (SELECT count(*) AS k FROM n)", "SELECT id, round(cos((row_number() OVER (ORDER BY seq) - 1) * 2 * pi() / k) * 500, 3) + 0.0 AS x, round(sin((row_number() OVER (ORDER BY seq) - 1) * 2 * pi() / k) * 500, 3) + 0.0 AS y FROM n, k"))
def layout_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda c: (F.round(F.col(c).cast("double"), 3) + 0.0).alias(c)
    return L.run_layout(trade(spark, sf_dir), "circular").nodes.select("id", rounded("x"), rounded("y"))


@query()
def layout_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_layout(trade(spark, sf_dir), "random").nodes.select("id", "x", "y")


@query()
def layout_forceatlas2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_layout(trade(spark, sf_dir).checkpoint(), "ForceAtlas 2", 5).nodes.select("id", "x", "y")


@query()
def layout_fruchterman_reingold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_layout(trade(spark, sf_dir).checkpoint(), "Fruchterman Reingold", 5).nodes.select("id", "x", "y")


from . import session_queries  # noqa: E402, F401  registers the queries that call operators by name
