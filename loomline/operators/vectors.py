"""Vector search and correlation graphs over embeddings and series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.runtime import cut

MAX_QUERIES = 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine (0 for a zero vector), euclidean as 1 / (1 + distance), or dot."""
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(0.0)


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Top k of all vectors for each query (query_id, query), exact.

    The queries are a stated set: they are counted and sent to the vectors in blocks of at most
    MAX_QUERIES; the vectors stay where they are, and every task keeps k rows per query before
    anything is shuffled.
    """
    asked = queries.where("query is not null").select("query_id", "query")
    blocks = max(1, -(-asked.count() // MAX_QUERIES))
    rows = vectors.where(F.col(embedding).isNotNull()).select(vec_id, embedding)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), vec_id)
    out = None
    for b in range(blocks):
        q = F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
        scored = rows.crossJoin(q).select("query_id", vec_id, similarity(F.col(embedding), F.col("query"), metric).alias("score"))
        if threshold is not None:
            scored = scored.where(F.col("score") >= threshold)
        top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out


# ---------------------------------------------------------------------------------------------------- index

#: Vectors that the cells of an index are fitted on (a bounded sample, by hash of the id), and rounds of that.
FIT_ROWS, FIT_ROUNDS = 20_000, 12


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_cells(vectors: DataFrame, cells: int, vec_id: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """Centres of ``cells`` cells by spherical k-means over at most FIT_ROWS vectors."""
    rows = vectors.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(vec_id), vec_id).select(embedding).limit(FIT_ROWS).collect()
    x = unit(np.array([r[0] for r in rows], float)) if rows else np.zeros((0, 1))
    if len(x) <= cells:
        return x
    centres = x[:cells].copy()
    for _ in range(FIT_ROUNDS):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        used = np.bincount(at, minlength=cells) > 0
        centres[used] = unit(sums[used])
    return centres


def nearest_cells(embedding: Column, centres: np.ndarray, n: int) -> Column:
    """Numbers of the ``n`` cells whose centres are nearest by angle, nearest first."""
    centres = centres.astype(np.float32)

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        near = np.stack(v.to_list()).astype(np.float32) @ centres.T if len(v) else np.zeros((0, len(centres)))
        return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return run(embedding)


def indexed(vectors: DataFrame, centres: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """All vectors with their cell; write it partitioned or bucketed by ``cell`` to keep it."""
    return vectors.where(F.col(embedding).isNotNull()).withColumn("cell", F.element_at(nearest_cells(F.col(embedding), centres, 1), 1))


def index_search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Top k by cosine among the vectors of each query's ``probes`` nearest cells: a share of probes/cells of all pairs.

    A join on the cell, which adaptive execution splits where a cell is large; every task keeps k rows a
    query (a limit in the window's order) before they meet.
    """
    asked = queries.where("query is not null").select("query_id", "query", F.explode(nearest_cells(F.col("query"), centres, probes)).alias("cell"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), vec_id)
    scored = index.join(asked, "cell").select("query_id", vec_id, similarity(F.col(embedding), F.col("query")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quantized(embedding: Column, chunks: int = 8) -> Column:
    """Means of at most ``chunks`` equal slices."""
    size = F.greatest(F.ceil(F.size(embedding) / chunks), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(1), F.size(embedding), size)
    return F.transform(starts, lambda s: F.aggregate(F.slice(embedding, s, size), F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(F.slice(embedding, s, size)))


def dequantized(code: Column, length: Column, chunks: int = 8) -> Column:
    size = F.greatest(F.ceil(length / chunks), F.lit(1)).cast("int")
    return F.slice(F.flatten(F.transform(code, lambda x: F.array_repeat(x, size))), F.lit(1), length)


def sign_code(embedding: Column) -> Column:
    """First 64 signs as one number; near vectors differ in few bits."""
    bits = F.transform(F.slice(embedding, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pruned(embedding: Column, least: float = 0.1) -> Column:
    """(position, value) of the components above ``least`` in size."""
    return F.filter(F.transform(embedding, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda p: F.abs(p["x"]) > least)


def restored(kept: Column, length: Column) -> Column:
    """A pruned embedding with zeros where components are missing."""
    at = F.map_from_entries(kept)
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.coalesce(at[i], F.lit(0.0)))


def inverted(items: DataFrame, item_id: str, concepts: str) -> DataFrame:
    """(concept, item_id) of an array column, or of a plain one: look up by filtering ``concept``."""
    kind = items.schema[concepts].dataType.simpleString()
    each = F.explode(F.array_distinct(F.col(concepts))) if kind.startswith("array") else F.col(concepts)
    return items.select(each.alias("concept"), F.col(item_id)).where("concept is not null")


# ------------------------------------------------------------------------------------------------- graphs


def with_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with others added; of two weights of one pair the added one holds."""
    return edges.join(more, ["src", "dst"], "left_anti").select("src", "dst", "corr").unionByName(more.select("src", "dst", "corr"))


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "dst"], "left_anti").select("src", "dst", "corr")


def correlations(points: DataFrame, pairs: DataFrame, rank: bool = False) -> DataFrame:
    """Pearson (or with ``rank`` Spearman, ordinal ranks) of stated pairs (src, dst) of series (sid, t, x) over common t.

    Too few points or no variance give 0.
    """
    a = points.select(F.col("sid").alias("src"), "t", F.col("x").alias("xa"))
    b = points.select(F.col("sid").alias("dst"), "t", F.col("x").alias("xb"))
    j = pairs.join(a, "src").join(b, ["dst", "t"])
    if rank:
        w = Window.partitionBy("src", "dst")
        j = j.withColumn("ra", F.row_number().over(w.orderBy("xa", "t")).cast("double")).withColumn("rb", F.row_number().over(w.orderBy("xb", "t")).cast("double")).withColumn("xa", F.col("ra")).withColumn("xb", F.col("rb"))
    c = F.try_divide(F.covar_pop("xa", "xb"), F.stddev_pop("xa") * F.stddev_pop("xb"))
    return j.groupBy("src", "dst").agg(F.coalesce(c, F.lit(0.0)).alias("corr"))


def neighbours(edges: DataFrame, node: object) -> DataFrame:
    both = edges.select("src", "dst", "corr").union(edges.select(F.col("dst"), F.col("src"), "corr"))
    return both.where(F.col("src") == node).select("dst", "corr")


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k edges of the largest absolute correlation."""
    both = edges.select("src", "dst", "corr").union(edges.select(F.col("dst"), F.col("src"), "corr"))
    w = Window.partitionBy("src").orderBy(F.desc(F.abs("corr")), "dst")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def compressed(edges: DataFrame, least: float = 0.3) -> DataFrame:
    return edges.where(F.abs("corr") >= least)


def influential(edges: DataFrame, k: int) -> DataFrame:
    """Nodes with most edges."""
    both = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def communities(edges: DataFrame, least: float = 0.7, rounds: int = 50) -> DataFrame:
    """Connected components over edges above ``least``: (node, community = smallest node of it).

    Smallest-label propagation with pointer jumping; every round is kept in the checkpoint folder.
    """
    strong = edges.where(F.abs("corr") > least).select("src", "dst")
    both = cut(strong.union(strong.select("dst", "src")).distinct())
    labels = cut(both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("community")))
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("community").alias("m"))
        step = labels.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", F.least("community", F.coalesce("m", "community")).alias("community"))
        jump = step.select(F.col("node").alias("community"), F.col("community").alias("further"))
        new = cut(step.join(jump, "community", "left").select("node", F.least("community", F.coalesce("further", "community")).alias("community")))
        moved = new.join(labels.withColumnRenamed("community", "old"), "node").where("community <> old").limit(1).count()
        labels = new
        if not moved:
            break
    else:
        raise RuntimeError("communities did not settle; raise rounds")
    return labels
