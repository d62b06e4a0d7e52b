"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of one label (and dimension) are dealt into blocks of about ``TILE`` rows, and every pair
of blocks meets in one task: memory is that of two blocks, however large a label is, and a hot
label is split over as many tasks as it has block pairs. A tile multiplies the int8 codes of unit
vectors, exactly. With u = s q + e the cosine differs from s_u s_v (q_u . q_v) by at most
|e_u| |s_v q_v| + |u| |e_v|; pairs surely below the threshold are left, surely above are linked,
and only those between are computed in double precision. A tile returns counts of links and a
spanning forest, never its pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, null labels
and null ids link with nothing; vectors of different dimensions are not linked; every row is
returned; rows of one id, label and components are one vector to the others, rows of one id that
differ are vectors of their own that do not link with each other; an empty table gives no rows;
further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import column, connected_components, materialize

#: Rows of a block.
TILE = 1024
#: More than rounding can add to the bounds and to the products of scales.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of what the codes stand for, and norms of the errors, of unit rows."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    stands_for = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stands_for, axis=1), np.linalg.norm(unit - stands_for, axis=1)


def links(x: np.ndarray, y: np.ndarray, threshold: float, rows: int = 256):
    """Yields (i, j) index arrays of the pairs with cosine >= threshold, for rows of x and y.

    Rows are first divided by a power of two near their largest component, which changes no digit
    and keeps squares of very large and very small components in range.
    """
    x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(1))[1][:, None]) for z in (x, y))
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, _, ex = quantise(x / nx[:, None])
    qy, sy, my, ey = quantise(y / ny[:, None])
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products stay whole numbers
    right = qy.astype(exact).T
    for a in range(0, len(x), rows):
        b = slice(a, a + rows)
        near = (qx[b].astype(exact) @ right) * sx[b, None] * sy[None, :]
        bound = ex[b, None] * my[None, :] + ey[None, :] + SLACK
        i, j = np.nonzero(near + bound >= threshold)
        sure = near[i, j] - bound[i, j] >= threshold
        doubt = np.flatnonzero(~sure)
        for c in range(0, len(doubt), 8192):
            d = doubt[c : c + 8192]
            cosine = np.einsum("ij,ij->i", x[i[d] + a], y[j[d]]) / (nx[i[d] + a] * ny[j[d]])
            sure[d] = cosine >= threshold
        yield i[sure] + a, j[sure]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each node's component, for links a-b among n nodes."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return label


_OUT = "key bigint, other bigint, n bigint"


def _tile(threshold: float):
    schema = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def run(key, table):
        low, high = key[-2].as_py(), key[-1].as_py()
        ids, owner, block = table["key"].to_numpy(), table["id"].to_numpy(), table["block"].to_numpy()
        flat = table["v"].combine_chunks()
        data = (flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, owner, block, data = ids[order], owner[order], block[order], data[order]
        x = np.flatnonzero(block == low)
        y = x if low == high else np.flatnonzero(block == high)
        if not len(x) or not len(y):
            return pa.Table.from_pydict({"key": [], "other": [], "n": []}, schema)
        first, second = [], []
        for i, j in links(data[x], data[y], threshold):
            if low == high:
                i, j = i[i < j], j[i < j]
            apart = owner[x[i]] != owner[y[j]]
            i, j = i[apart], j[apart]
            first.append(x[i])
            second.append(y[j])
        a, b = np.concatenate(first), np.concatenate(second)
        n = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        root = forest(len(ids), a, b)
        counted, joined = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(ids)))
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.concat_tables([
            pa.table([pa.array(ids[counted]), none(len(counted)), pa.array(n[counted])], schema=schema),
            pa.table([pa.array(ids[joined]), pa.array(ids[root[joined]]), none(len(joined))], schema=schema),
        ])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    rows = vectors.select(column(id_col).cast("bigint").alias("id"), column(label_col).alias("label"), column(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    one = rows.where(usable).groupBy("id", "label", "v").agg(F.count("*").alias("copies"))
    one = materialize(one.withColumns({"key": F.monotonically_increasing_id(), "dim": F.size("v")}), "vectors")
    counts = one.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    blocks = one.join(counts, ["label", "dim"]).withColumn("blocks", F.ceil(F.col("rows") / tile).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", "dim", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "key", "id", "block", "v")
    found = materialize(met.groupBy("label", "dim", "low", "high").applyInArrow(_tile(threshold), _OUT), "links")
    n = found.where("n is not null").groupBy("key").agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
    least = parts.join(one.select("key", "id"), "key").groupBy("component").agg(F.min("id").alias("component_id"))
    out = one.select("key", "id", "copies").join(n, "key", "left").join(parts.join(least, "component").select("key", "component_id"), "key", "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    component = F.coalesce("component_id", "id")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    return out.unionByName(rows.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))
