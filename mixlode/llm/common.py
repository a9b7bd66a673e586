"""Scratch tables in the shared folder, key filters, numbering of equal rows, and connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Where scratch tables go if the session names no folder: within Spark's warehouse, which a cluster shares too.
_OWN = "mixlode-scratch"
#: Deletes a query's shuffle files when it ends, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{root}/mixlode" if root else f"{spark.conf.get('spark.sql.warehouse.dir')}/{_OWN}"


def small_batches(spark: SparkSession) -> None:
    """Batches that go to Python are kept small, as a task holds a few copies of one: texts can be long.  Changes no result."""
    for name, most, unit in (("maxRecordsPerBatch", 4096, ""), ("maxBytesPerBatch", 8 << 20, "b")):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, f"{most}{unit}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Deletes all scratch tables made so far; results that still read them are lost.  Runs at exit by itself."""
    while _made:
        spark, path = _made.pop()
        sc = spark.sparkContext
        if sc._jsc is not None:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean_at_exit() -> None:
    try:
        clean()
    except Exception:  # noqa: BLE001  the JVM is gone already
        _made.clear()


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... within rows of equal keys (nulls are equal), without a task for each key.

    Rows are counted within the partitions of `df` and the counts summed up, so a key
    with many rows is spread over as many tasks as it has partitions.  Rows are stored
    with their partitions first, so both passes see the same ones.
    """
    group, record = F.struct(*[F.col(k) for k in keys]), F.struct(*[F.col(f"`{c}`") for c in df.columns])
    marked = stored(df.select(group.alias("g"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"), record.alias("r")), "numbered")
    inner = F.row_number().over(Window.partitionBy("g", "p").orderBy("m"))
    upto = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n")).select("g", "p", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    both = marked.withColumn("i", inner).join(starts.hint("merge"), ["g", "p"])
    return both.select("r.*", (F.col("start") + F.col("i") - 1).alias(name))


#: Bits of a key filter, at most (16 MB), and of one of its slices.
FILTER_BITS, PART_BITS = 27, 20


def _places(keys: np.ndarray, log_bits: int) -> list[np.ndarray]:
    """Two places for each key, from different bits of it."""
    k = keys.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << log_bits) - 1)
    return [(k & mask).astype(np.int64), (k >> np.uint64(64 - log_bits)).astype(np.int64)]


def key_bits(keys: DataFrame) -> np.ndarray:
    """A filter (packed bits) of a column of 64-bit hashes: 16 bits a key up to 2^FILTER_BITS, beyond that it lets more through."""
    n = keys.count()
    log_bits = min(FILTER_BITS, max(PART_BITS, (16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False), log_bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> PART_BITS).astype(np.int32)), pa.array((at & ((1 << PART_BITS) - 1)).astype(np.int32))], ["part", "at"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(1 << PART_BITS, bool))[at[part == p]] = True
        for p, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros(1 << (log_bits - 3), np.uint8)
    size = 1 << (PART_BITS - 3)
    marked = keys.mapInArrow(places, "part int, at int")
    for r in marked.repartition(1 << (log_bits - PART_BITS), "part").mapInArrow(parts, "part int, bits binary").toLocalIterator():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter lets each key through: all that it was made of, and a few others."""
    ok = np.ones(len(keys), bool)
    for at in _places(keys, (len(bits) * 8).bit_length() - 1):
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def selected(keyed: DataFrame, bits: np.ndarray, through: bool = True, once: list[str] | None = None) -> DataFrame:
    """The rows of keyed (with a 64-bit column `key`) that a filter lets through, or those that it does not; map-only.

    once: of the rows let through, a task passes only the first that is equal in these columns.
    """
    at, same = keyed.columns.index("key"), [keyed.columns.index(c) for c in once or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            mask = passing(bits, b.column(at).to_numpy(zero_copy_only=False)) == through
            if same:
                for i in np.flatnonzero(mask).tolist():
                    row = tuple(b.column(c)[i].as_py() for c in same)
                    mask[i] = row not in seen
                    seen.add(row)
            if mask.any():
                yield b.filter(pa.array(mask))

    return keyed.mapInArrow(run, keyed.schema)


def sides(yes: DataFrame, no: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Filters that tell rows of keys (64-bit column `key`) in `yes` from rows of keys in `no`: of yes, and of what that one lets through of no."""
    first = key_bits(yes.select("key"))
    return first, key_bits(stored(selected(no.select("key"), first), f"{name}-beside"))


def told(keyed: DataFrame, filters: tuple[np.ndarray, np.ndarray], sure: bool = True) -> DataFrame:
    """Adds `told` to the rows of keyed whose side the filters are sure of, whether it is yes; or (sure=False) gives the others; map-only.

    Sure is what either filter stops, if every key is in yes or no; a key in both is never sure.
    """
    at = keyed.columns.index("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(at).to_numpy(zero_copy_only=False)
            yes = passing(filters[0], keys)
            mask = (yes & passing(filters[1], keys)) != sure
            if mask.any():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(yes)], [*b.schema.names, "told"]).filter(pa.array(mask))

    return keyed.mapInArrow(run, T.StructType([*keyed.schema.fields, T.StructField("told", T.BooleanType())]))


#: Edges that one task unites at the end; more are contracted first.
FINISH = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of at most FINISH edges, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "label"])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) for every node of `edges` (a, b): nodes have equal labels when connected.

    Contraction: each node points to the neighbour (or itself) of least hash, a
    fresh hash each round; edges move to those, loops and repeats go.  Expected
    rounds: logarithmic in the longest path.  At FINISH edges or fewer, a number that
    no input changes, one task unites the rest.  A label is some node of its component.
    """
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    if (left := live.count()) <= FINISH:
        return stored(live.repartition(1).mapInArrow(_united, "node long, label long"), f"{name}-united")
    nodes = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    labels, rounds = nodes.withColumn("label", F.col("node")), 0
    while left > FINISH:
        rounds += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(rounds), F.col(c)), F.col(c).alias("v"))
        both = live.select("a", "b").union(live.select("b", "a"))
        parent = both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["v"].alias("p"))
        parent = stored(parent, f"{name}-parent-{rounds}")
        up = lambda c: parent.select(F.col("a").alias(c), F.col("p").alias(f"p{c}"))
        moved = live.join(up("a"), "a").join(up("b"), "b").where("pa <> pb")
        live = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges-{rounds}")
        step = parent.select(F.col("a").alias("label"), "p")
        labels = stored(labels.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label")), f"{name}-labels-{rounds}")
        left = live.count()
    last = stored(live.repartition(1).mapInArrow(_united, "node long, label long"), f"{name}-united").select(F.col("node").alias("label"), F.col("label").alias("p"))
    return labels.join(last, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
