"""Connected components of a model's observers, and clusters of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import MOST_OBSERVERS, solved

_HERE, _EDGE = 0, 1
#: Edges that are held before they are cut down to a spanning forest.
HELD = 1 << 20


def _solve(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of one model: rows (kind, a, b) of its nodes and edges, in any order. Holds the nodes,
    of which a model has a bounded number, and a bounded number of edges."""
    nodes, edges = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    def forest() -> tuple[np.ndarray, np.ndarray]:
        known, at = np.unique(edges, return_inverse=True)
        part = np.arange(len(known))
        return known, known[solved(part, at.reshape(-1, 2))]

    for batch in rows:
        kind = batch["kind"].to_numpy()
        nodes = np.unique(np.concatenate([nodes, batch["a"].to_numpy(np.int64)[kind == _HERE]]))
        if len(nodes) > MOST_OBSERVERS:
            raise ValueError(f"a model has at most {MOST_OBSERVERS} observers")
        edges = np.concatenate([edges, batch[["a", "b"]].to_numpy(np.int64)[kind == _EDGE]])
        if len(edges) > HELD:
            edges = forest()[1]
    root = dict(zip(nodes.tolist(), nodes.tolist(), strict=True))
    if len(edges):
        root |= {n: r for r, n in forest()[1].tolist()}
    yield pd.DataFrame({"oid": nodes, "component": np.array([root[n] for n in nodes.tolist()], np.int64)})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(oid, component): the smallest id of each connected set; nodes without edges are alone.

    Nodes are the observers of one model, a number that its capacity bounds and that does not grow
    with the stream; nodes and edges of a model meet in one task, which fails beyond that number.
    """
    none = F.lit(0).cast("bigint").alias("b")
    rows = nodes.select(F.lit(_HERE).alias("kind"), F.col("oid").cast("bigint").alias("a"), none)
    rows = rows.unionByName(edges.select(F.lit(_EDGE).alias("kind"), F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b")))
    return rows.coalesce(1).mapInPandas(_solve, "oid bigint, component bigint")


def clusters(parts: DataFrame, min_size: int) -> DataFrame:
    """(oid, label): components of at least ``min_size`` observers are numbered by their least
    id; observers of smaller ones get -1. Only the component ids are ranked."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    named = sizes.select("component", (F.row_number().over(Window.orderBy("component")) - 1).cast("int").alias("label"))
    return parts.join(named, "component", "left").select("oid", F.coalesce("label", F.lit(-1)).alias("label"))
