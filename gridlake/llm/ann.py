"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Vectors are projected on single random directions; for each direction a block keeps its projections as one sorted array.
A query opens a window around its own projection in every array and counts, for each vector, in how many windows it
lies. By virtual rehashing the windows grow with a radius, geometrically, without building anything anew: only what a
window gains is counted. Vectors that reach the collision threshold are verified by their inner product, and a query is
done as soon as its k-th best verified vector lies within the radius reached.

Inner products become distances by one more coordinate that lifts all vectors to the length of the longest; the
directions are orthonormal, which makes the counts steadier than independent ones.

Every vector is indexed and every query meets every block: cells (block of vectors, block of queries) of bounded size
are dealt over the cluster, and the best k of each cell are merged. No block is ever larger, however alike its vectors.
How many queries share a cell changes what is shuffled, never what is found, as a query searches each block by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Directions, half width of a window in units of the radius, share of the directions in which a vector must collide.
DIRECTIONS, WIDTH, SHARE = 64, 1.0, 0.64
#: First radius (the longest vector has length 1), growth of the radius, and the radius that reaches everything.
RADIUS, GROWTH, WHOLE = 0.9, 1.07, 2.0
#: Vectors of a cell; its queries, from the fewest to the most, the fewer while there are not so many CELLS.
BLOCK, QUERIES, MOST_QUERIES, CELLS = 1 << 13, 1 << 10, 1 << 13, 1 << 12


def directions(dim: int, m: int = DIRECTIONS, seed: int = 7) -> np.ndarray:
    """``m`` unit directions, orthonormal in groups of ``dim``."""
    draw = np.random.default_rng(seed)
    groups = [np.linalg.qr(draw.standard_normal((dim, dim)))[0].T for _ in range(-(-m // dim))]
    return np.concatenate(groups)[:m]


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())) if len(ids) else 1.0
        unit = vectors / self.longest
        lift = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
        self.axes = directions(vectors.shape[1] + 1)
        projected = np.column_stack([unit, lift]) @ self.axes.T
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of the vectors verified as its best ``k``, itself left out."""
        n, m = len(self.ids), len(self.axes)
        scale = np.sqrt(vectors_length(queries))
        centre = np.column_stack([queries / scale[:, None], np.zeros(len(queries))]) @ self.axes.T
        need = int(np.ceil(SHARE * m))
        radii = [RADIUS]
        while radii[-1] < WHOLE:
            radii.append(radii[-1] * GROWTH)
        half = [WIDTH * r / np.sqrt(self.axes.shape[1]) for r in radii]
        # windows of all queries at all radii, by one binary search an array and side
        low = np.stack([np.searchsorted(a, (centre[:, [i]] - np.array(half)).ravel(), "left") for i, a in enumerate(self.sorted)], 1)
        high = np.stack([np.searchsorted(a, (centre[:, [i]] + np.array(half)).ravel(), "right") for i, a in enumerate(self.sorted)], 1)
        low, high = low.reshape(len(queries), len(radii), m), high.reshape(len(queries), len(radii), m)
        rows = list(self.order)
        out = []
        for j in range(len(queries)):
            own = self.ids == query_ids[j]
            most = min(k, n - int(own.sum()))
            count = np.zeros(n, np.int64)
            waiting = ~own
            found, scores = np.zeros(0, np.int64), np.zeros(0)
            a = b = None
            for t, r in enumerate(radii):
                lo, hi = low[j, t].tolist(), high[j, t].tolist()
                if a is None:
                    gained = [x[p:q] for x, p, q in zip(rows, lo, hi)]
                else:
                    gained = [x[p:q] for x, p, q in zip(rows, lo, a)] + [x[p:q] for x, p, q in zip(rows, b, hi)]
                a, b = lo, hi
                count += np.bincount(np.concatenate(gained), minlength=n)
                new = np.flatnonzero((count >= need) & waiting)
                if len(new):
                    waiting[new] = False
                    found = np.concatenate([found, new])
                    scores = np.concatenate([scores, self.vectors[new] @ queries[j]])
                if most <= 0 or len(found) >= most and 2.0 - 2.0 * np.partition(scores, -most)[-most] / (scale[j] * self.longest) <= r * r:
                    break
            else:  # the last radius holds all vectors but for ones that few windows reach
                rest = np.flatnonzero(waiting)
                found, scores = np.concatenate([found, rest]), np.concatenate([scores, self.vectors[rest] @ queries[j]])
            best = np.lexsort((self.ids[found], -scores))[: max(most, 0)]
            out.append((self.ids[found[best]], scores[best]))
        return out


def vectors_length(vectors: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    return np.einsum("ij,ij->i", vectors, vectors)


def takes_part(vector: Column) -> Column:
    """Vectors without null and non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows whose vec_id ``every`` divides, the ``k`` of largest inner product.

    ``vectors`` has vec_id and embedding. Rows with a null vec_id, and vectors that are null, zero or hold null or
    non-finite components, take no part; vectors of another length than the query's are no candidates. Of rows that
    share a vec_id and a length one counts (that whose components come first). Ties go to the smaller vec_id; with fewer candidates
    than ``k`` all are returned; an empty table gives an empty result.
    """
    given = vectors.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(given, T.FloatType) else F.col("embedding").cast("array<double>")
    usable = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & takes_part(F.col("v")))
    # one row an id, combined before the shuffle, so that a much repeated id is no hot key
    usable = cut(usable.groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v")))
    asks = F.col("vec_id") % every == 0
    n, n_queries = usable.agg(F.count(F.lit(1)), F.count(F.when(asks, 1))).first()
    blocks = max(1, -(-n // block))
    parts = max(1, -(-n_queries // max(queries, MOST_QUERIES)), min(-(-n_queries // queries), -(-CELLS // blocks)))
    spread = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = usable.select("dim", spread(blocks, 1).alias("block"), each(parts).alias("part"), F.lit(False).alias("asks"), "vec_id", "v")
    ask = usable.where(asks).select("dim", each(blocks).alias("block"), spread(parts, 2).alias("part"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(key, cell):
        dim = key[0].as_py()
        kind = cell.column("asks").to_numpy()
        ids = cell.column("vec_id").to_numpy().astype(np.int64)
        flat = pa.compute.list_flatten(cell.column("v")).to_numpy().astype(np.float64).reshape(-1, dim)

        def ordered(mask):
            i, x = ids[mask], flat[mask]
            order = np.argsort(i, kind="stable")
            return i[order], x[order]

        (vec_ids, vecs), (query_ids, asked) = ordered(~kind), ordered(kind)
        index = Block(vec_ids, vecs) if len(vec_ids) and len(query_ids) else None
        got = [g for at in range(0, len(query_ids), QUERIES) for g in index.search(query_ids[at : at + QUERIES], asked[at : at + QUERIES], k)] if index else []
        empty = np.zeros(0, np.int64)
        return pa.table({
            "query_id": np.repeat(query_ids[: len(got)], [len(i) for i, _ in got]) if got else empty,
            "vec_id": np.concatenate([i for i, _ in got]) if got else empty,
            "score": np.concatenate([s for _, s in got]) if got else np.zeros(0),
        })

    cells = data.union(ask).groupBy("dim", "block", "part")
    near = cells.applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
