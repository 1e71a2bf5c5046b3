"""Problem 5: the k most similar vectors of every vector.

Method: collision-counting hashing. Every vector has one coordinate in each of ``LINES``
single projections, kept as sorted arrays. A query counts, over the projections, how
often a vector lies in its window; windows are centred on the query and widen from round
to round (virtual rehashing) until k vectors are found within the round's radius.
Vectors that collide often enough are verified by their cosine.

So that a task sees a bounded part of the collection, the first projections are cut into
ranges: a tree of single projections, fitted on a bounded sample, sends every vector to
one leaf, and a query also visits the leaves its window reaches. A leaf that would be too
large is cut into a grid of query and vector parts.

Defined cases
    null or zero vector     -> not in the collection, no neighbours
    vectors of other length -> compared by direction; another dimension is left out
    equal vectors           -> one vector with a multiplicity; never expanded before the end
    ties at rank k          -> all of them are neighbours
    rows delivered twice    -> one vector
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows the tree is fitted on at most; every row is indexed.
SAMPLE = 65_536
#: Vectors of a leaf aimed at, and rows of one kernel call at most.
LEAF, MOST_ROWS = 4096, 32_768
#: Projections, how many of them must collide, and half the window in standard deviations of a projected difference.
LINES, COLLISIONS, WIDTH = 16, 14, 2.2
#: Half the window of a query at a branching of the tree, in the same unit.
REACH = 0.9
SCALE = 200.0
TILE = 128
#: Share of a tile that must collide for the tile to be verified as a whole.
DENSE = 0.02


def projections(dim: int) -> np.ndarray:
    """Orthonormal directions, the same on every machine."""
    rng = np.random.RandomState(7_919)
    q, _ = np.linalg.qr(rng.randn(dim, max(dim, LINES)))
    return np.ascontiguousarray(q[:, :LINES] if dim >= LINES else rng.randn(dim, LINES) / math.sqrt(dim), np.float32)


class Tree:
    """Ranges of single projections: at each branching one direction and one bound, both from the sample."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.dim = depth, sample.shape[1] if len(sample) else 1
        nodes = (1 << depth) - 1
        self.line, self.bound = np.zeros((nodes, self.dim), np.float32), np.zeros(nodes, np.float32)
        held = {0: np.arange(len(sample))}
        for node in range(nodes):
            at = held.pop(node, np.arange(0))
            if len(at) > 1:
                part = sample[at]
                _, axes = np.linalg.eigh(np.cov(part.T) if self.dim > 1 else np.eye(1))
                self.line[node] = axes[:, -1]
                p = part @ self.line[node]
                self.bound[node] = np.median(p)
                right = p > self.bound[node]
                held[2 * node + 1], held[2 * node + 2] = at[~right], at[right]

    def query_parts(self, sample: np.ndarray, reach: float, rows: int) -> np.ndarray:
        """Per leaf: in how many parts its queries are cut, from the visits of the sample. 1 unless a leaf is hot."""
        parts = np.ones(1 << self.depth, np.int64)
        if len(sample):
            seen = np.bincount(self.visits(sample, reach)[1], minlength=1 << self.depth)
            parts = np.maximum(1, -(-(seen * (rows / len(sample))) // MOST_ROWS)).astype(np.int64)
        return parts

    def home(self, v: np.ndarray) -> np.ndarray:
        node = np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", v, self.line[node]) > self.bound[node])
        return node - ((1 << self.depth) - 1)

    def visits(self, v: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves the windows reach, the home leaf among them."""
        rows, node = np.arange(len(v)), np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", v[rows], self.line[node]) - self.bound[node]
            right = p > 0
            near = np.abs(p) <= reach
            rows, node = np.concatenate([rows, rows[near]]), np.concatenate([2 * node + 1 + right, 2 * node[near] + 1 + ~right[near]])
        return rows, node - ((1 << self.depth) - 1)


def collide(q: np.ndarray, x: np.ndarray, radii: tuple[float, ...], k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine): per query the k most similar of ``x``, ties included, as far as the last radius reaches.

    Rows are unit vectors. Equal rows are the caller's to leave out.
    """
    lines, sigma = projections(x.shape[1]), 1 / math.sqrt(x.shape[1])
    px, pq = x @ lines, q @ lines
    by_first = np.argsort(px[:, 0], kind="stable")
    x, px = x[by_first], px[by_first]
    cells = np.ascontiguousarray(np.clip((px + 0.64) * SCALE, 0, 255).astype(np.uint8).T)
    spot = np.clip((pq + 0.64) * SCALE, 0, 255).astype(np.int16)
    todo, out = np.argsort(pq[:, 0], kind="stable"), []
    for n, radius in enumerate(radii):
        last, half = n == len(radii) - 1, WIDTH * radius * sigma
        bins, left = int(math.ceil(half * SCALE)), []
        bound = max(least, -2.0 if last else 1 - radius * radius / 2)
        for at in range(0, len(todo), TILE):
            tile = todo[at : at + TILE]
            a, b = np.searchsorted(px[:, 0], (pq[tile[0], 0] - half, pq[tile[-1], 0] + half))
            if a < b:
                low = np.clip(spot[tile] - bins, 0, 255)
                span = (np.clip(spot[tile] + bins, 0, 255) - low).astype(np.uint8)
                low = low.astype(np.uint8)
                hits = np.zeros((len(tile), b - a), np.uint8)
                for j in range(LINES):
                    hits += (cells[j, a:b][None, :] - low[:, j, None]) <= span[:, j, None]
                met = hits >= COLLISIONS
                if np.count_nonzero(met) > DENSE * met.size:  # wide windows: verify the tile as one product
                    product = q[tile] @ x[a:b].T
                    rows, cols = np.nonzero(met & (product >= bound))
                    cos = product[rows, cols]
                else:
                    rows, cols = np.nonzero(met)
                    cos = np.einsum("ij,ij->i", q[tile[rows]], x[a + cols]) if len(rows) else np.zeros(0, np.float32)
            else:
                rows, cols, cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
            near = cos >= bound
            enough = np.bincount(rows[near], minlength=len(tile)) >= k
            take = near & (enough[rows] | last)
            out.append((tile[rows[take]], by_first[a + cols[take]], cos[take]))
            left.append(tile[~enough])
        todo = np.concatenate(left) if left else todo[:0]
        if last or not len(todo):
            break
    rows, cols, cos = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    cos = np.round(cos.astype(np.float64), 6)
    order = np.lexsort((-cos, rows))
    rows, cols, cos = rows[order], cols[order], cos[order]
    first = np.searchsorted(rows, rows)
    kth = np.minimum(first + k - 1, np.searchsorted(rows, rows, side="right") - 1)
    keep = cos >= cos[kth] if len(cos) else np.zeros(0, bool)
    return rows[keep], cols[keep], cos[keep]


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32)
    v = flat.reshape(-1, dim)
    return v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def usable(vector: str, dim: int) -> Column:
    """Vectors of the collection: of its dimension, without nulls, not zero."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def dimension(df: DataFrame, vector: str) -> int:
    """The dimension most vectors have (0: there is no vector)."""
    row = df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def fit(df: DataFrame, vector: str, key: Column, dim: int, rows: int) -> tuple[Tree, np.ndarray]:
    """The tree and its sample: at most about ``SAMPLE`` rows picked by a digest of their key."""
    part = max(1, math.ceil(rows / SAMPLE))
    picked = df.filter((F.pmod(F.xxhash64(key, F.lit(17)), F.lit(part)) == 0) & usable(vector, dim)).select(vector)
    table = picked.toArrow()
    sample = _vectors(table.column(0).combine_chunks(), dim) if table.num_rows else np.zeros((0, dim), np.float32)
    leaves = rows / LEAF
    depth = max(0, min(int(math.ceil(math.log2(leaves))) if leaves > 1 else 0, int(math.log2(max(1, len(sample) / 16)))))
    return Tree(sample, depth), sample


def _spread(tree: Tree, dim: int, reach: float, parts: int, q_parts: np.ndarray):
    """Arrow batches of (vkey, vector) to rows of the leaves' grids. Each vector leaves a partition once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            keys = batch.column("vkey").to_numpy()
            fresh = np.array([k not in done and not done.add(k) for k in keys.tolist()], bool)
            if not fresh.any():
                continue
            kept = batch.filter(pa.array(fresh))
            keys, v = kept.column("vkey").to_numpy(), _vectors(kept.column("vector"), dim)
            home = tree.home(v)
            rows, leaf = tree.visits(v, reach)
            own = np.flatnonzero(leaf == home[rows])
            packed = v.view(np.uint8).reshape(len(v), -1)
            # A grid per leaf: a query goes to one row of it, a vector to one column of it.
            share = keys[rows].astype(np.uint64)
            line, column = (share // np.uint64(parts)) % q_parts[leaf].astype(np.uint64), share % np.uint64(parts)
            for p in range(parts):
                for s in range(int(q_parts[leaf].max())):
                    is_q = (line == s).astype(bool)
                    is_x = np.zeros(len(rows), bool)
                    is_x[own] = (column[own] == p) & (q_parts[leaf[own]] > s)
                    use = np.flatnonzero(is_q | is_x)
                    cell = ((leaf[use] * parts + p) << 20) + s
                    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(use), [None, pa.py_buffer(np.ascontiguousarray(packed[rows[use]]))])
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(keys[rows[use]]), pa.array(is_x[use]), pa.array(is_q[use]), data.cast(pa.binary())], ["cell", "vkey", "is_x", "is_q", "v"])

    return run


def _kernel(dim: int, radii: tuple[float, ...], k: int, least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("vkey")
        keys, v = group["vkey"].to_numpy(), np.frombuffer(b"".join(group["v"]), np.float32).reshape(-1, dim)
        here, at = np.flatnonzero(group["is_q"].to_numpy().astype(bool)), np.flatnonzero(group["is_x"].to_numpy().astype(bool))
        if not len(at) or not len(here):
            return pd.DataFrame({"q": keys[:0], "x": keys[:0], "cosine": np.zeros(0)})
        q, x, cos = collide(v[here], v[at], radii, k + 1, least)  # one more: a vector finds itself
        q, x = keys[here[q]], keys[at[x]]
        other = q != x
        return pd.DataFrame({"q": q[other], "x": x[other], "cosine": cos[other]})

    return run


def similar_vectors(df: DataFrame, key: str, vector: str, k: int, least: float) -> DataFrame:
    """(a, b, cosine): pairs of keys, a < b, with cosine of at least ``least`` of which one is among the k most similar of the other. Equal vectors and ties are included."""
    dim = dimension(df, vector)
    if not dim:
        return df.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("cosine")).limit(0)
    rows = df.count()
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    tree, sample = fit(df, vector, F.col(key), dim, rows)
    reach = REACH * radius / math.sqrt(dim)
    good = df.filter(usable(vector, dim)).select(F.col(key).alias("_id"), F.xxhash64(vector).alias("vkey"), F.col(vector).alias("vector"))
    members = cut(good.select("_id", "vkey").distinct(), "vector-members")
    many = members.groupBy("vkey").agg(F.count("*").alias("m"))
    parts = max(1, math.ceil(rows / (1 << tree.depth) / MOST_ROWS))
    cells = good.select("vkey", "vector").mapInArrow(_spread(tree, dim, reach, parts, tree.query_parts(sample, reach, rows)), "cell long, vkey long, is_x boolean, is_q boolean, v binary")
    kernel = _kernel(dim, (radius / 2, radius), k, least - 1e-6)
    found = cut(cells.groupBy("cell").applyInPandas(kernel, "q long, x long, cosine double"), "vector-pairs")
    sides = found.unionByName(found.select(F.col("x").alias("q"), F.col("q").alias("x"), "cosine"))
    sides = sides.groupBy("q", "x").agg(F.max(F.round(F.col("cosine") * 1e6).cast("long")).alias("s"))
    sides = sides.join(many.select(F.col("vkey").alias("x"), F.col("m").alias("mx")), "x").join(many.select(F.col("vkey").alias("q"), F.col("m").alias("mq")), "q")
    above = F.sum("mx").over(Window.partitionBy("q").orderBy(F.col("s").desc()).rangeBetween(Window.unboundedPreceding, -1))
    above = F.coalesce(above, F.lit(0)) + F.when(F.col("s") < 1_000_000, F.col("mq") - 1).otherwise(0)
    chosen = sides.withColumn("_above", above).filter((F.col("_above") < k) & (F.col("s") >= round(least * 1e6)))
    chosen = chosen.groupBy(F.least("q", "x").alias("q"), F.greatest("q", "x").alias("x")).agg(F.max("s").alias("s"))
    left, right = members.select(F.col("_id").alias("_a"), F.col("vkey").alias("q")), members.select(F.col("_id").alias("_b"), F.col("vkey").alias("x"))
    unlike = chosen.join(left, "q").join(right, "x").select("_a", "_b", "s")
    alike = left.join(right, F.col("q") == F.col("x")).filter("_a < _b").select("_a", "_b", F.lit(1_000_000).cast("long").alias("s"))
    both = unlike.unionByName(alike)
    return both.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg((F.max("s") / 1e6).alias("cosine"))


def neighbours_of(df: DataFrame, key: str, vector: str, queries: Column, k: int, block: int = 16_384) -> DataFrame:
    """(key, rank, neighbour, cosine): the k most similar rows of each row that ``queries`` names, against all rows in blocks."""
    dim = dimension(df, vector)
    kind = dict(df.dtypes)[key]
    schema = f"q {kind}, x {kind}, cosine double"
    good = df.filter(usable(vector, dim)).dropDuplicates([key]) if dim else df.limit(0)
    blocks = max(1, math.ceil(df.count() / block))
    x = good.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(True).alias("is_x"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    q = good.filter(queries).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(False).alias("is_x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        is_x = group["is_x"].to_numpy().astype(bool)
        ids, v = group["id"].to_numpy(), np.stack(group["v"].to_numpy()).astype(np.float32)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.flatnonzero(~is_x), np.flatnonzero(is_x)
        if not len(a) or not len(b):
            return pd.DataFrame({"q": ids[:0], "x": ids[:0], "cosine": np.zeros(0)})
        rows, cols, cos = collide(v[a], v[b], (0.45, 1.0, 1.2, 2.0), k + 1, -2.0)
        out = pd.DataFrame({"q": ids[a[rows]], "x": ids[b[cols]], "cosine": cos})
        return out[out["q"] != out["x"]].sort_values(["q", "cosine", "x"], ascending=[True, False, True]).groupby("q").head(k)

    found = x.unionByName(q).groupBy("block").applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "x"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(key), "rank", F.col("x").alias("neighbour"), F.round("cosine", 6).alias("cosine"))
