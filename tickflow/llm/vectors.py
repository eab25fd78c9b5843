"""Operator 8: near-duplicate vectors by spherical k-means cells and blocked products.

Method.  Spherical k-means, fitted on a bounded sample, gives cells; every
vector is assigned to its nearest cells; within a cell, blocks of vectors are
compared by matrix products in double precision; links form components, and
the smallest id of each is kept.

Equal vectors are one class from the start, so thousands of copies are one
vector with a count.  A cell of any size is cut into blocks of ``block``
classes, and each pair of blocks of a cell is a task's unit of work: memory
is two blocks, and a large cell is spread over the cluster.  Links are not
emitted as pairs: a unit returns counts of links and a spanning forest.  A
pair that meets in several cells counts in the first they share.  Vectors
go to all cells whose cosine is within ``margin`` of the nearest, which
keeps recall high; below two times ``cell_rows`` classes one cell holds all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.frames import components, outputs_last, written

#: The fit: sampled vectors at most, cells at most, classes aimed at in a cell, rounds.
SAMPLE, MAX_CELLS, CELL_ROWS, ROUNDS = 50_000, 4096, 1024, 12
#: Products held at once in the fit (32 MB).
FIT_NUMBERS = 4 << 20
#: Cells of a vector: those within ``MARGIN`` in cosine of its nearest, ``PROBES`` at most.
MARGIN, PROBES = 0.1, 4
#: Classes in a block of the product.
BLOCK = 1024


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids; an empty cell keeps its former centroid."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    step = max(1, FIT_NUMBERS // max(len(centroids), 1))  # rows whose products are held at once
    for _ in range(rounds):
        cell = np.concatenate([np.argmax(vectors[at:at + step] @ centroids.T, axis=1) for at in range(0, len(vectors), step)])
        total = np.zeros_like(centroids)
        np.add.at(total, cell, vectors)
        size = np.sqrt(np.einsum("ij,ij->i", total, total))
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centroids)
    return centroids


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Links (indices into a, b) that connect what all links connect."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(i)
    return np.asarray(out, np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    values = flat.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _links(threshold: float):
    """All links within one pair of blocks of a cell: counts per class, and a spanning forest."""
    def run(key, table):
        table = table.combine_chunks()
        node, count, cells = (table.column(c).to_pylist() for c in ("node", "count", "cells"))
        block = table.column("block").to_numpy()
        vectors = unit_rows(_matrix(table.column("vector")))
        cell, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a, b = np.nonzero(vectors[left] @ vectors[right].T >= threshold)
        a, b = left[a], right[b]
        once = a < b if low == high else a != b
        a, b = a[once], b[once]
        width = max(len(c) for c in cells)  # a pair belongs to the first cell both are in
        own = np.array([c + [1 << 30] * (width - len(c)) for c in cells], np.int64)
        first = np.full(len(a), 1 << 30)
        for i in range(width):
            for j in range(width):
                same = own[a, i] == own[b, j]
                first[same] = np.minimum(first[same], own[a, i][same])
        mine = first == cell
        a, b = a[mine], b[mine]
        weight = np.asarray(count, np.float64)
        links = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
        some = np.flatnonzero(links)
        tree = forest(a, b, len(node))
        node = np.asarray(node, np.int64)
        return pa.table({
            "node": pa.array(np.concatenate([node[some], node[a[tree]]])),
            "links": pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(tree), np.int64)])),
            "other": pa.array([None] * len(some) + node[b[tree]].tolist(), pa.int64())})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding",
                    sample: int = SAMPLE, cell_rows: int = CELL_ROWS, margin: float = MARGIN, probes: int = PROBES,
                    block: int = BLOCK) -> DataFrame:
    """``vectors`` plus n_links (other rows linked directly), component_id (smallest key reachable) and kept.

    Linked: cosine in double precision at or above ``threshold``.  Vectors
    that are null, empty or zero, or hold null or non-finite components, link
    with nothing; nor do vectors of different lengths.  Equal vectors link
    with each other.  Rows with the same key are rows of their own.  A null
    key cannot be a component's id: it counts as larger than all.  Columns
    named like an output are replaced.  ``sample`` bounds the rows that the
    cells are fitted on; all rows are compared.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.struct(*[F.col(c) for c in vectors.columns]).alias("row"), F.col(key).alias("id"),
                          F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))  # -0.0 is 0.0
    rows = rows.withColumn("node", F.when(good, F.xxhash64("v"))).withColumn("check", F.when(good, F.xxhash64(F.lit(5), "v")))
    classes = (rows.where("node is not null")
               .groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("count"), F.first("v").alias("vector"),
                                    F.min("check").alias("c1"), F.max("check").alias("c2")))
    classes = written(classes.withColumn("id", F.when(F.col("c1") == F.col("c2"), F.col("id")).otherwise(
        F.raise_error(F.lit("two vectors share a hash")).cast("long"))).drop("c1", "c2"), "vectors")
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("vector")).count().collect()}  # one row per length
    centroids = {}
    for length, n in sizes.items():
        k = min(max(n // cell_rows, 1), MAX_CELLS)
        if k > 1:
            share = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
            part = classes.where((F.size("vector") == length) & share).select("vector").limit(2 * sample).toPandas()
            centroids[length] = spherical_kmeans(unit_rows(np.stack(part["vector"].to_numpy())), k)
    shared = spark.sparkContext.broadcast(centroids)  # MAX_CELLS x length doubles at most for each length

    @F.pandas_udf("array<int>")
    def assign(vector: pd.Series) -> pd.Series:
        out = []
        for x in vector:
            x = np.asarray(x, np.float64)
            base = len(x) << 13  # cells of vectors of different lengths are apart
            c = shared.value.get(len(x))
            if c is None:
                out.append([base])
                continue
            cos = c @ (x / np.sqrt(x @ x))
            near = np.argsort(-cos, kind="stable")[:probes]
            out.append(np.sort(base + near[cos[near] >= cos[near[0]] - margin]).tolist())
        return pd.Series(out)

    members = written(classes.select("node", "count", "vector", assign("vector").alias("cells"))
                      .withColumn("cell", F.explode("cells")), "vectors")
    cell_sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = (members.join(cell_sizes, "cell")
               .withColumn("block", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("blocks")).cast("int")))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = (units.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
             .select("cell", "low", "high", "block", "node", "count", "cells", "vector"))
    found = written(units.groupBy("cell", "low", "high").applyInArrow(_links(threshold), "node long, links long, other long"),
                    "vectors")
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), spark)
    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    tagged = (classes.select("node", "id", "count").join(direct, "node", "left").join(roots, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    names = tagged.groupBy("root").agg(F.min("id").alias("component"))
    tagged = tagged.join(names, "root").select(
        "node", "component", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n"))
    out = (rows.join(tagged, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
           .withColumn("component", F.coalesce("component", "id")))
    return outputs_last(out, "row", n_links="n", component_id="component", kept=F.col("component") == F.col("id"))
