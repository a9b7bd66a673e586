"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are projected on the leading principal dimensions (fitted on a bounded
sample, used for every vector), put into grid cells of side epsilon, the Euclidean
distance of the cosine limit, and sorted by cell, dimension after dimension.  The
sorted sequence is cut into blocks.  Pairs of blocks whose bounding boxes are
further apart than epsilon are skipped; the others are joined by recursion on
intervals of the sequence, which skips distant halves in the same way, down to
leaves that are compared by exact cosines in double precision.  A last dimension is the
length of what the axes leave over.  Projections on orthonormal axes, and differences
of such lengths, never lengthen a distance, so nothing is missed.

Equal vectors are one vector with a multiplicity.  A leaf emits counts and a
spanning set of links, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths never link; repeated rows and rows that repeat an id are rows of their own;
the component is the smallest id reached; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlode.llm.common import components, stored

#: Bytes of the vectors of one block, as doubles: what a task holds is two blocks, a few times over.
BLOCK_BYTES = 8 << 20
#: Vectors that the principal dimensions are fitted on, and their number.
SAMPLE = 4096
AXES = 8
#: Intervals up to this long are compared without further splitting.
LEAF = 512
#: Tasks that share the pairs of blocks, at most; a task streams its pairs one by one.
PAIR_TASKS = 50_000
#: Blocks whose boxes a task compares with those of as many others.
BOX_TILE = 2048
#: Hits of a leaf up to which they are united pair by pair.
FEW = 4096
#: Room for rounding in projections and boxes; the root in a rest's length makes 1e-16 into 1e-8.
SLACK = 1e-7


def usable(x: str = "embedding"):
    """Whether a vector can have a cosine."""
    v = F.col(x)
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.isNotNull() & good & F.exists(v, lambda e: e != 0)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(reps: DataFrame, sample: int = SAMPLE, axes: int = AXES) -> dict[int, np.ndarray]:
    """Leading axes (dim, k) for each vector length, from at most `sample` vectors chosen by hash."""
    rows = reps.orderBy(F.xxhash64(F.lit(9), "node"), "node").limit(sample).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for dim, vectors in by_dim.items():
        x = unit_rows(pa.array(vectors, pa.list_(pa.float64())), dim)
        _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        out[dim] = v[: min(axes, dim)].T.copy()
    return out


def _axes_of(axes: dict[int, np.ndarray], dim: int, k: int) -> np.ndarray:
    """A length that the sample missed is projected on its first coordinates."""
    return axes.get(dim, np.eye(dim)[:, : min(k, dim)])


def projected(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows on the axes, and the length of the rest."""
    p = x @ axes
    return np.hstack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1, keepdims=True)))])


def _gridded(axes: dict[int, np.ndarray], eps: float, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column("embedding").offsets.to_numpy())
            cells = np.zeros((b.num_rows, k), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                p = unit_rows(b.column("embedding").take(pa.array(rows)), int(dim)) @ _axes_of(axes, int(dim), k)
                cells[rows, : p.shape[1]] = np.floor(p / eps)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(list(cells), pa.list_(pa.int64()))], [*b.schema.names, "dim", "cell"])

    return run


class _Interval:
    """Vectors of the sequence with their projections."""

    def __init__(self, nodes: np.ndarray, mult: np.ndarray, x: np.ndarray, axes: np.ndarray) -> None:
        self.nodes, self.mult, self.x, self.p = nodes, mult, x, projected(x, axes)


def far(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether two sets of projections are provably further apart than eps."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return bool((gap * gap).sum() > (eps + SLACK) ** 2)


class _Join:
    """Recursive join of intervals; sums counts and unites linked vectors."""

    def __init__(self, left: _Interval, right: _Interval | None, cosine: float, eps: float) -> None:
        self.cosine, self.eps = cosine, eps
        self.a, self.b = left, right or left
        self.same = right is None
        self.count_a, self.count_b = np.zeros(len(left.nodes), np.int64), np.zeros(len(self.b.nodes), np.int64)
        n = len(left.nodes) + (0 if self.same else len(self.b.nodes))
        self.parent = list(range(n))
        if self.same:
            self.recurse(0, n)
        else:
            self.cross(0, len(left.nodes), 0, len(self.b.nodes))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def recurse(self, i: int, j: int) -> None:
        """An interval of one block with itself."""
        if j - i <= LEAF:
            self.leaf(i, j, i, j)
            return
        h = (i + j) // 2
        self.recurse(i, h)
        self.recurse(h, j)
        self.cross(i, h, h, j)

    def cross(self, i: int, j: int, k: int, m: int) -> None:
        """Two disjoint intervals."""
        if i >= j or k >= m or far(self.a.p[i:j], self.b.p[k:m], self.eps):
            return
        if j - i <= LEAF and m - k <= LEAF:
            self.leaf(i, j, k, m)
        elif j - i >= m - k:
            h = (i + j) // 2
            self.cross(i, h, k, m)
            self.cross(h, j, k, m)
        else:
            h = (k + m) // 2
            self.cross(i, j, k, h)
            self.cross(i, j, h, m)

    def leaf(self, i: int, j: int, k: int, m: int) -> None:
        hit = self.a.x[i:j] @ self.b.x[k:m].T >= self.cosine
        own = self.same and i == k and j == m
        if own:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.count_a[i:j] += hit @ self.b.mult[k:m]
        if not own:
            self.count_b[k:m] += self.a.mult[i:j] @ hit
        shift = k + (0 if self.same else len(self.a.nodes))
        if np.count_nonzero(hit) <= FEW:
            for r, c in np.argwhere(hit).tolist():
                self.unite(i + r, c + shift)
            return
        rest = hit.any(axis=1)
        while rest.any():  # spreads from one row to its columns, to their rows, and so on
            rows, cols = np.zeros(j - i, bool), np.zeros(m - k, bool)
            front = np.array([int(rest.argmax())])
            rows[front] = True
            while len(front):
                new = hit[front].any(axis=0) & ~cols
                cols |= new
                back = hit[:, new].any(axis=1) & ~rows
                rows |= back
                front = np.flatnonzero(back)
            rest &= ~rows
            first = i + int(rows.argmax())
            for c in [*(np.flatnonzero(rows) + i).tolist(), *(np.flatnonzero(cols) + shift).tolist()]:
                self.unite(first, c)

    def unite(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def result(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes with links, their counts, and the node that each is joined with."""
        count = self.count_a + self.count_b if self.same else np.concatenate([self.count_a, self.count_b])
        nodes = self.a.nodes if self.same else np.concatenate([self.a.nodes, self.b.nodes])
        got = np.flatnonzero(count)
        return nodes[got].tolist(), count[got].tolist(), [int(nodes[self.find(int(i))]) for i in got]


def _block_join(axes: dict[int, np.ndarray], cosine: float, eps: float, k: int) -> Callable:
    """Streams (i, j, block, node, mult, embedding, dim) sorted by pair of blocks; yields (node, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pair = None

        def joined() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            block, dims = t["block"].to_numpy(), t["dim"].to_numpy()
            for dim in np.unique(dims):
                parts = []
                for b in sorted({pair[0], pair[1]}):
                    rows = np.flatnonzero((block == b) & (dims == dim))
                    sub = t.take(pa.array(rows)).combine_chunks()
                    emb = sub["embedding"].chunk(0) if sub["embedding"].num_chunks else pa.array([], pa.list_(pa.float64()))
                    parts.append(_Interval(sub["node"].to_numpy(), sub["mult"].to_numpy(), unit_rows(emb, int(dim)) if len(rows) else np.zeros((0, int(dim))), _axes_of(axes, int(dim), k)))
                if all(len(p.nodes) for p in parts):
                    nodes, counts, roots = _Join(parts[0], parts[1] if len(parts) > 1 else None, cosine, eps).result()
                    if nodes:
                        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(roots, pa.int64())], ["node", "links", "root"])

        for b in batches:
            i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
            cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if (int(i[a]), int(j[a])) != pair:
                    yield from joined()
                    held.clear()
                    pair = (int(i[a]), int(j[a]))
                held.append(b.slice(a, z - a))
        yield from joined()

    return run


def near_vectors(table: DataFrame, cosine: float = 0.9, block: int | None = None, name: str = "vectors") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table (vec_id, embedding); block: vectors of a block, else BLOCK_BYTES counts."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = usable()
    marked = rows.withColumn("embedding", F.transform("embedding", lambda e: e + F.lit(0.0)))  # -0.0 becomes 0.0
    node = F.when(good, F.xxhash64("embedding")).alias("node")
    ids = stored(marked.select("vec_id", node), f"{name}-ids")
    reps = stored(marked.where(good).groupBy("embedding").agg(F.count(F.lit(1)).alias("mult")).select(F.xxhash64("embedding").alias("node"), "mult", "embedding"), f"{name}-distinct")
    amount = reps.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("cells")).first()
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    axes = principal_axes(reps)
    grid = reps.mapInArrow(_gridded(axes, max(eps, 1e-6), AXES), "node long, mult long, embedding array<double>, dim int, cell array<long>")
    blocks = max(1, -(-amount["n"] // block) if block else -(-8 * amount["cells"] // BLOCK_BYTES))
    ordered = grid.repartitionByRange(blocks, "dim", *[F.col("cell")[i] for i in range(AXES)], "node") if blocks > 1 else grid.coalesce(1)
    sequence = stored(ordered.withColumn("part", F.spark_partition_id()).sortWithinPartitions("dim", "cell", "node"), f"{name}-sequence")
    parts = 1 + (sequence.agg(F.max("part")).first()[0] or 0)
    # runs of partitions make the blocks, however many partitions the sort has made
    sequence = sequence.withColumn("block", F.floor(F.col("part") * blocks / parts).cast("int")).drop("part")

    boxes = sequence.mapInArrow(_boxes(axes), "block int, dim int, low array<double>, high array<double>")
    merged = boxes.groupBy("block", "dim").agg(F.array(*[F.min(F.col("low")[i]) for i in range(AXES + 1)]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in range(AXES + 1)]).alias("high"))
    near = stored(near_blocks(merged, blocks, eps), f"{name}-near")
    n_pairs = near.where("block <= p").count()
    pairs = sequence.join(near, "block").select(F.least("block", "p").alias("i"), F.greatest("block", "p").alias("j"), "block", "node", "mult", "embedding", "dim", "cell")
    sent = pairs.repartition(max(1, min(n_pairs, PAIR_TASKS)), "i", "j").sortWithinPartitions("i", "j", "block", "dim", "cell", "node").drop("cell")
    found = stored(sent.mapInArrow(_block_join(axes, cosine, eps, AXES), "node long, links long, root long"), f"{name}-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), f"{name}-components")
    copies = ids.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("first"))
    named = copies.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = named.join(least, "label").join(links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = ids.join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _boxes(axes: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[tuple[int, int], np.ndarray] = {}
        high: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            block, dims = b.column("block").to_numpy(), b.column("dim").to_numpy()
            for key in set(zip(block.tolist(), dims.tolist(), strict=True)):
                rows = np.flatnonzero((block == key[0]) & (dims == key[1]))
                p = projected(unit_rows(b.column("embedding").take(pa.array(rows)), key[1]), _axes_of(axes, key[1], AXES))
                p = np.pad(p, ((0, 0), (0, AXES + 1 - p.shape[1])))
                low[key] = np.minimum(low[key], p.min(axis=0)) if key in low else p.min(axis=0)
                high[key] = np.maximum(high[key], p.max(axis=0)) if key in high else p.max(axis=0)
        if low:
            keys = list(low)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([low[k].tolist() for k in keys]), pa.array([high[k].tolist() for k in keys])], ["block", "dim", "low", "high"])

    return run


def near_blocks(boxes: DataFrame, blocks: int, eps: float, tile: int = BOX_TILE) -> DataFrame:
    """(block, p): blocks and those, themselves included, that are not provably distant; boxes has a row for each block and length.

    Boxes meet in tiles of `tile` blocks by `tile` blocks, so neither the driver nor a task holds them all.
    """
    tiles, own = -(-blocks // tile), F.floor(F.col("block") / tile).cast("int")
    box = ["block", "dim", "low", "high"]
    left = boxes.select(own.alias("i"), F.explode(F.sequence(own, F.lit(tiles - 1))).alias("j"), F.lit(0).alias("side"), *box)
    right = boxes.select(F.explode(F.sequence(F.lit(0), own)).alias("i"), own.alias("j"), F.lit(1).alias("side"), *box)
    sent = left.unionByName(right).repartition(min(tiles * (tiles + 1) // 2, PAIR_TASKS), "i", "j").sortWithinPartitions("i", "j", "side")
    return sent.mapInArrow(_near_pairs(eps), "block int, p int")


def _near_pairs(eps: float) -> Callable:
    """Streams boxes sorted by tile; yields the near pairs of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def pairs() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            side, block, dims = (t[c].to_numpy() for c in ("side", "block", "dim"))
            low, high = (np.array(t[c].to_pylist()) for c in ("low", "high"))
            found = [np.stack([np.unique(block)] * 2)]
            for dim in np.unique(dims):
                a, b = (np.flatnonzero((dims == dim) & (side == s)) for s in (0, 1))
                for r in a.tolist():
                    gap = np.maximum(0, np.maximum(low[b] - high[r], low[r] - high[b]))
                    p = block[b[(gap * gap).sum(axis=1) <= (eps + SLACK) ** 2]]
                    found += [np.stack([np.full(len(p), block[r]), p]), np.stack([p, np.full(len(p), block[r])])]
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            if at[0] != at[1]:  # a block with itself is of the tile on the diagonal
                both = both[:, both[0] != both[1]]
            yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.int32()), pa.array(both[1], pa.int32())], ["block", "p"])

        for b in batches:
            i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
            cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if (int(i[x]), int(j[x])) != at:
                    yield from pairs()
                    held.clear()
                    at = (int(i[x]), int(j[x]))
                held.append(b.slice(x, y - x))
        yield from pairs()

    return run


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: links at cosine 0.9 and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9)


SQL = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM g a JOIN g b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
t AS (SELECT r AS a, r AS b FROM e UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
c AS (SELECT t.a AS r, min(e.vec_id) AS component_id FROM t JOIN e ON e.r = t.b GROUP BY t.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.r) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM e JOIN c USING (r)"""
