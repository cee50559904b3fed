"""Logical inputs of the queries, built from the driver's tables, and the same as DuckDB CTEs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import durable
from ..functions.vectors import as_doubles
from ..operators.detectors import Direction
from ..operators.graph import contrastive_consistency
from ..operators.neighbours import knn_graph, undirected
from ..operators.split import split_nodes

K = 10


@dataclass
class Tables:
    """Frames of one query; what several parts of it read is stored once, in the shared folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        base = self.table("embeddings").select(F.col("vec_id").alias("node_id"), as_doubles(F.col("embedding")).alias("x"), F.col("label").alias("cluster"), (F.col("label") == 0).cast("int").alias("y"))
        return durable(split_nodes(base).select("node_id", "x", "y", "cluster", "is_novel", "split"))

    @cached_property
    def scores(self) -> DataFrame:
        return Direction().fit(self.nodes).score(self.nodes)

    @cached_property
    def knn(self) -> DataFrame:
        return durable(knn_graph(self.nodes, K))

    @cached_property
    def edges(self) -> DataFrame:
        return undirected(self.knn, "i", "j")

    @cached_property
    def scored(self) -> DataFrame:
        """Nodes without vectors, with score."""
        return durable(self.nodes.drop("x").join(self.scores, "node_id"))

    @cached_property
    def rows(self) -> DataFrame:
        """Scored nodes with contrastive consistency."""
        c = contrastive_consistency(self.nodes, self.knn).withColumn("c", F.round("c", 9))
        return durable(self.scored.join(c, "node_id"))

    @cached_property
    def trade(self) -> DataFrame:
        """Customer to supplier edges of the orders, one per pair."""
        o = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("src"))
        li = self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("dst"))
        return li.join(o, "o_orderkey").select("src", (F.col("dst") + 10_000_000).alias("dst")).distinct()

    @cached_property
    def traders(self) -> DataFrame:
        """Nodes of the trade graph with nation as label."""
        c = self.table("customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
        s = self.table("supplier").select((F.col("s_suppkey") + 10_000_000).alias("node_id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
        return c.unionByName(s)

    @cached_property
    def judged(self) -> DataFrame:
        """Labelled documents: score is the text's length, y its toxicity."""
        d = self.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("s"), "lang")
        return d.join(self.table("labels"), "doc_id").select("doc_id", "s", F.col("toxic").alias("y"), "quality", "lang")

    @cached_property
    def seeds(self) -> DataFrame:
        return self.nodes.where("split = 'cal' AND y = 0").select("node_id")

    @cached_property
    def results(self) -> DataFrame:
        """Long results: per market segment (dataset), order year (seed) and priority (method) the mean price in thousands."""
        o = self.table("orders").join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("dataset")), "o_custkey")
        return o.groupBy("dataset", F.year("o_orderdate").alias("seed"), F.col("o_orderpriority").alias("method")).agg((F.avg("o_totalprice") / 1000).alias("value")).withColumn("metric", F.lit("price"))


#: DuckDB twins, in order of dependence.
CTES = {
    "e": "SELECT vec_id AS node_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label AS cluster, (label = 0)::INT AS y FROM embeddings",
    "novel": "SELECT cluster FROM e WHERE y = 0 GROUP BY 1 ORDER BY count(*), cluster LIMIT 2",
    "seen": "SELECT node_id, row_number() OVER (ORDER BY md5(concat(node_id, ':42')), node_id) AS rn, count(*) OVER () AS n FROM e WHERE cluster NOT IN (FROM novel)",
    "nodes": """SELECT e.node_id, x, y, cluster, cluster IN (FROM novel) AS is_novel, CASE WHEN rn IS NULL THEN 'test' WHEN rn <= floor(0.4 * n) THEN 'train'
        WHEN rn <= floor(0.4 * n) + floor(0.2 * n) THEN 'cal' ELSE 'test' END AS split, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM e LEFT JOIN seen USING (node_id)""",
    "lng": "SELECT node_id, unnest(x) AS val, generate_subscripts(x, 1) - 1 AS dim FROM nodes",
    "mu": """SELECT list(m ORDER BY d) AS mu FROM (SELECT d, avg(v) AS m FROM (SELECT unnest(u) AS v, generate_subscripts(u, 1) AS d FROM nodes WHERE split = 'train' AND y = 0) GROUP BY d)""",
    "scores": "SELECT node_id, round((1 - list_dot_product(u, mu) / sqrt(list_dot_product(mu, mu))) / 2, 9) AS s FROM nodes, mu",
    "scored": "SELECT node_id, y, cluster, is_novel, split, s FROM nodes JOIN scores USING (node_id)",
    "pairs": "SELECT a.node_id AS i, b.node_id AS j, CASE WHEN a.node_id = b.node_id THEN -1.0 ELSE round(1 - list_dot_product(a.u, b.u), 9) END AS d FROM nodes a, nodes b",
    "knn": "SELECT i, j, (rn - 1)::INT AS rank, greatest(d, 0.0) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM pairs) WHERE rn <= 11",
    "edges": "SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM knn WHERE i <> j",
    "ways": "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges",
    "cent": "SELECT i AS node_id, list(m ORDER BY dim) AS centroid FROM (SELECT i, dim, avg(val) AS m FROM knn JOIN lng ON j = lng.node_id GROUP BY 1, 2) GROUP BY 1",
    "muc": """SELECT list(m ORDER BY d) AS mu FROM (SELECT d, avg(v) AS m FROM (SELECT unnest(u) AS v, generate_subscripts(u, 1) AS d FROM nodes WHERE split = 'cal' AND y = 0) GROUP BY d)""",
    "cons": """SELECT node_id, round(1 / (1 + exp(-list_dot_product(u, centroid) / sqrt(list_dot_product(centroid, centroid))))
        * 1 / (1 + exp(-list_dot_product(u, mu) / sqrt(list_dot_product(mu, mu)))), 9) AS c FROM nodes JOIN cent USING (node_id), muc""",
    "rows_": "SELECT * FROM scored JOIN cons USING (node_id)",
    "deg": "SELECT node_id, greatest(coalesce(v, 0), 1) AS d_v, greatest(coalesce(w, 0), 1) AS d_e FROM (SELECT i AS node_id, count(*) AS w FROM knn GROUP BY 1) FULL JOIN (SELECT j AS node_id, count(*) AS v FROM knn GROUP BY 1) USING (node_id)",
    "trade": "SELECT DISTINCT o_custkey AS src, l_suppkey + 10000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "traders": "SELECT c_custkey AS node_id, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey + 10000000, s_nationkey, s_acctbal FROM supplier",
    "judged": "SELECT doc_id, n_chars::DOUBLE AS s, toxic AS y, quality, lang FROM documents JOIN labels USING (doc_id)",
    "results": """SELECT c_mktsegment AS dataset, year(o_orderdate)::INT AS seed, o_orderpriority AS method, avg(o_totalprice) / 1000 AS value, 'price' AS metric
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "cal": "SELECT * FROM rows_ WHERE split = 'cal' AND y = 0",
    "test": "SELECT * FROM rows_ WHERE split = 'test'",
}


def with_ctes(names: str, query: str) -> str:
    """The query with the CTEs it names and all that these need."""
    import re

    need: set[str] = set()

    def add(name: str) -> None:
        if name in CTES and name not in need:
            need.add(name)
            for word in re.findall(r"\w+", CTES[name]):
                if word != name:
                    add(word)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in CTES.items() if n in need) + "\n" + query
