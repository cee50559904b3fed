"""Sources and sinks of graphs, scores, masks and results."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import hash_uniform

#: Nodes that ``block_model`` takes; all pairs of them are drawn against one broadcast side.
MOST_BLOCK_NODES = 100_000
RESULT_SCHEMA = "dataset string, seed int, alpha double, method string, metric string, value double"


def read_csv_triple(spark: SparkSession, classes: str, features: str, edges: str, unknown: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """Classes with header, features without one, edges with header; label "1" is anomalous, unknown labels leave with their edges."""
    labels = spark.read.csv(classes, header=True).toDF("node_id", "label").where(F.col("label") != unknown)
    wide = spark.read.csv(features)
    x = F.array(*[F.col(c).cast("double") for c in wide.columns[1:]])
    nodes = wide.select(F.col(wide.columns[0]).alias("node_id"), x.alias("x")).join(labels.select("node_id", (F.col("label") == "1").cast("int").alias("y")), "node_id")
    links = spark.read.csv(edges, header=True).toDF("src", "dst")
    for end in ("src", "dst"):
        links = links.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return nodes, links.select("src", "dst")


def read_npz(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Arrays ``feature``, ``label``, ``edge_index`` (kind nodes or edges) or ``scores`` (kind scores), one file per task."""
    schema = {"nodes": "path string, node_id long, x array<double>, y int", "edges": "path string, src long, dst long", "scores": "path string, node_id long, s double, y int"}[kind]

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in files:
            for path, content in zip(pdf["path"], pdf["content"]):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                if kind == "edges":
                    e = data["edge_index"]
                    yield pd.DataFrame({"path": path, "src": e[0].astype("int64"), "dst": e[1].astype("int64")})
                elif kind == "nodes":
                    x = data["feature"].astype("float64")
                    yield pd.DataFrame({"path": path, "node_id": np.arange(len(x)), "x": list(x), "y": data["label"].astype("int32")})
                else:
                    s = data["scores"].astype("float64")
                    yield pd.DataFrame({"path": path, "node_id": np.arange(len(s)), "s": s, "y": data["y"].astype("int32")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """``(node_id, mask)`` from a JSON object of id lists."""
    raw = spark.read.json(path, multiLine=True)
    lists = [c for c, t in raw.dtypes if t.startswith("array<bigint")]
    return raw.select(F.explode(F.array(*[F.struct(F.lit(c).alias("mask"), F.col(c).alias("ids")) for c in lists])).alias("m")).select(F.explode("m.ids").alias("node_id"), F.col("m.mask").alias("mask"))


def read_results(spark: SparkSession, path: str, pattern: str = r"([^/_]+)_s(\d+)_") -> DataFrame:
    """Result files with dataset and seed taken from their names."""
    rows = spark.read.schema("alpha double, method string, metric string, value double").json(path).withColumn("file", F.input_file_name())
    return rows.select(F.regexp_extract("file", pattern, 1).alias("dataset"), F.regexp_extract("file", pattern, 2).cast("int").alias("seed"), "alpha", "method", "metric", "value")


def multi_relation(relations: dict[str, DataFrame]) -> DataFrame:
    """Union of relations' edges, each edge once."""
    frames = [e.select("src", "dst") for e in relations.values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions, without self-loops and repeats."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def block_model(spark: SparkSession, sizes: tuple[int, int] = (600, 200), p_in: float = 0.02, p_out: float = 0.002, anomalies: float = 0.05, dim: int = 16, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two-block random graph of a bounded number of nodes, Gaussian features and hash-drawn anomalies."""
    n = sum(sizes)
    ids = spark.range(n).withColumnRenamed("id", "node_id").withColumn("block", (F.col("node_id") >= sizes[0]).cast("int"))
    u = lambda *p: F.greatest(hash_uniform(*p), F.lit(1e-9))
    gauss = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.sqrt(-2 * F.log(u("node_id", d, F.lit(seed)))) * F.cos(2 * np.pi * u("node_id", d, F.lit(seed + 1))))
    nodes = ids.withColumn("y", (hash_uniform("node_id", F.lit(seed + 2)) < anomalies).cast("int")).withColumn("x", F.transform(gauss, lambda v: v + F.col("block") + 1.5 * F.col("y")))
    a, b = ids.select(F.col("node_id").alias("src"), F.col("block").alias("bs")), ids.select(F.col("node_id").alias("dst"), F.col("block").alias("bd"))
    p = F.when(F.col("bs") == F.col("bd"), p_in).otherwise(p_out)
    if n > MOST_BLOCK_NODES:
        raise ValueError(f"every pair of nodes is drawn, so {MOST_BLOCK_NODES} nodes are the most")
    edges = a.crossJoin(F.broadcast(b)).where("src < dst").where(hash_uniform("src", "dst", F.lit(seed + 3)) < p).select("src", "dst")
    return nodes, edges


def read_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Stored graph: nodes with their masks (see ``official_split``), and edges undirected, each once and without loops."""
    links = spark.read.parquet(edges).where("src <> dst")
    return spark.read.parquet(nodes), links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def official_split(nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``split`` from boolean masks ``columns`` (train, test to column names); calibration rows are the training normals.

    A mask that is missing is false everywhere; of a mask with several columns (an array) the
    first counts. Test rows win over training rows.
    """
    kinds = dict(nodes.dtypes)

    def mask(which: str) -> Column:
        name = columns.get(which)
        if name not in kinds:
            return F.lit(False)
        c = F.get(F.col(name), 0) if kinds[name].startswith("array") else F.col(name)
        return F.coalesce(c.cast("boolean"), F.lit(False))

    split = F.when(mask("test"), "test").when(mask("train") & (F.col("y") == 0), "cal").when(mask("train"), "train").otherwise("none")
    return nodes.withColumn("split", split)


def from_coordinates(entries: DataFrame, width: int, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """``(node_id, x)`` from a sparse matrix as rows of coordinates; repeated entries add up, missing ones are 0."""
    summed = entries.groupBy(row, col).agg(F.sum(F.col(value).cast("double")).alias("v"))
    maps = summed.groupBy(F.col(row).alias("node_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col).cast("int"), "v"))).alias("m"))
    return maps.select("node_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("x"))


def one_hot_label(nodes: DataFrame, label: str = "label") -> DataFrame:
    """The place of the largest entry of a one-hot label, the first of equal ones."""
    return nodes.withColumn(label, (F.array_position(label, F.array_max(label)) - 1).cast("int"))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> dict[str, int]:
    """Store nodes and symmetric edges, read them back and compare their numbers."""
    both = symmetric(edges)
    write_table(nodes, f"{folder}/nodes")
    write_table(both, f"{folder}/edges")
    spark = nodes.sparkSession
    counts = {name: (df.count(), spark.read.parquet(f"{folder}/{name}").count()) for name, df in (("nodes", nodes), ("edges", both))}
    if wrong := {k: v for k, v in counts.items() if v[0] != v[1]}:
        raise ValueError(f"rows before and after storing differ: {wrong}")
    return {k: v[1] for k, v in counts.items()}


def write_mask(masks: DataFrame, path: str) -> None:
    """Store ``masks(node_id, mask)`` as rows of JSON, one a mask and part; ``read_mask_rows`` reads them."""
    parts = masks.withColumn("part", F.pmod(F.xxhash64("node_id"), F.lit(64))).groupBy("mask", "part").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    parts.write.mode("overwrite").json(path)


def read_mask_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("mask string, part int, ids array<bigint>").json(path).select(F.explode("ids").alias("node_id"), "mask")


def random_masks(nodes: DataFrame, trials: int = 20, train: float = 0.4, seed: int = 42) -> DataFrame:
    """``(node_id, trial, split)``: per trial the first rows in hash order train, the others test."""
    from ..operators.split import hash_rank

    each = nodes.select("node_id").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    keyed = each.withColumn("key", F.concat_ws("/", "trial", F.col("node_id").cast("string")))
    ranked = hash_rank(keyed, "key", seed, ("trial",))
    return ranked.select("node_id", "trial", F.when(F.col("rn") <= F.floor(train * F.col("n")), "train").otherwise("test").alias("split"))


MANIFEST = "output string, method string, dataset string, written timestamp, parameters string"


def add_to_manifest(spark: SparkSession, path: str, output: str, method: str, dataset: str, **parameters) -> None:
    """Append an entry: what was written, by which method, for which data, when and how."""
    import json

    row = spark.createDataFrame([(output, method, dataset, json.dumps(parameters, sort_keys=True, default=str))], "output string, method string, dataset string, parameters string")
    row.withColumn("written", F.current_timestamp()).select("output", "method", "dataset", "written", "parameters").coalesce(1).write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    """Entries whose columns equal the given values, with the time as text."""
    rows = spark.read.schema(MANIFEST).parquet(path)
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), equal.items(), rows).withColumn("written", F.date_format("written", "yyyy-MM-dd HH:mm:ss"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> str:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def append_results(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append cells that are not stored yet, so a sweep can be resumed."""
    spark = new.sparkSession
    try:
        stored = spark.read.schema(RESULT_SCHEMA).parquet(path)
        stored.limit(0).collect()
    except Exception as error:  # the first call finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], RESULT_SCHEMA)
    new.join(stored.select(*keys), keys, "left_anti").write.mode("append").parquet(path)
