"""Sharding by a two-pass external shuffle, with built-in functions only.

Pass 1 scatters whole records uniformly into buckets of bounded bytes, by a seeded
hash of their contents.  Pass 2 puts each bucket in hash order, Fisher-Yates shuffles
it (the built-in seeded `shuffle`) and writes it to the shared folder.  The buckets'
row counts, summed up, turn places in a bucket into places in the whole order, and
place p goes to shard p mod n as slot p div n: shard counts differ by one at most.

The order depends on the records and the seed only, not on files or partitions.
Records that are equal in every key are numbered first where there are so many that
they would overfill a bucket, and their numbers are hashed too.

Defined cases: nulls are values like any other (a null text has size 1 and the
checksum of no bytes); repeated rows are separate rows; an empty table gives an empty
result; further columns are carried whatever their names and types (maps as their
entries meanwhile), but those named like a result column are replaced by it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mixlode.llm.common import numbered, stored

#: Bytes of one bucket (a bucket is one array in one task), and rows, for narrow records.
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 32768
#: Buckets whose starts are broadcast.
SMALL_STARTS = 1_000_000


def record_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes: its strings and binaries, and 16 for any other column."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    nested = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    return reduce(add, [*wide, *nested], F.lit(16 * len(df.columns))).cast("long")


def _packed(df: DataFrame) -> Column:
    """The record as one struct that can be ordered; fields c0, c1, ..."""
    field = lambda f: F.map_entries(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
    return F.struct(*[field(f).alias(f"c{i}") for i, f in enumerate(df.schema)])


def _unpacked(schema: T.StructType) -> list[Column]:
    field = lambda i, f: F.map_from_entries(F.col(f"r.c{i}")) if isinstance(f.dataType, T.MapType) else F.col(f"r.c{i}")
    return [field(i, f).alias(f.name) for i, f in enumerate(schema)]


def shuffled(df: DataFrame, keys: list[str], seed: int = 0, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Writes the shuffled buckets; gives place (a uniform random, gapless order from 0) and r, the record.

    keys: columns that the seeded hash reads; narrow ones that tell most rows apart are
    best, as the whole record orders rows of equal hash.  A bucket has about
    bucket_bytes, and bucket_rows rows at most, so a task's memory is a few times that.
    """
    amount = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(record_bytes(df)), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-amount["n"] // bucket_rows), -(-amount["bytes"] // bucket_bytes))
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys])
    hashed = df.select(key.alias("h"), _packed(df).alias("r"))
    # keys that alone would fill an eighth of a bucket, at most 8 for each bucket: their records are hashed whole, equal ones by their number
    most = max(1, amount["n"] // buckets // 8)
    heavy = stored(df.select(key.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("h"), "sharding-heavy")
    if not heavy.isEmpty():
        whole = hashed.join(heavy, "h", "left_semi").select(F.xxhash64(F.lit(seed), "r").alias("h"), "r")
        spread = numbered(whole, ["h"], "i").select(F.xxhash64(F.lit(seed), "h", "i").alias("h"), "r")
        hashed = hashed.join(heavy, "h", "left_anti").unionByName(spread)
    scattered = hashed.select(F.pmod(F.col("h"), F.lit(buckets)).alias("b"), F.struct(F.xxhash64("h").alias("h"), "r").alias("x"))
    held = scattered.repartition(min(buckets, 100_000), "b").groupBy("b").agg(F.collect_list("x").alias("xs"))
    # in bucket order within a partition, so that a rerun draws the same numbers
    mixed = held.sortWithinPartitions("b").select("b", F.shuffle(F.array_sort("xs"), seed).alias("xs")).select("b", F.posexplode("xs").alias("i", "x"))
    written = stored(mixed.select("b", "i", F.col("x.r").alias("r")), "sharding-buckets")
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(written.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", before.alias("start")), "sharding-starts")
    # one row a bucket: 16 MB at most; more buckets than that are joined by a shuffle
    starts = F.broadcast(starts) if buckets <= SMALL_STARTS else starts.hint("merge")
    return written.join(starts, "b").select((F.col("start") + F.col("i")).alias("place"), "r")


def sharded(df: DataFrame, keys: list[str], shards: int = 8, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows with shard (int), slot (long, gapless from 0 in each shard) and law ('rows')."""
    if shards < 1:
        raise ValueError("shards must be positive")
    n = F.lit(shards)
    added = [F.pmod("place", n).cast("int").alias("shard"), F.floor(F.col("place") / n).cast("long").alias("slot"), F.lit("rows").alias("law")]
    carried = [c for c, name in zip(_unpacked(df.schema), df.columns, strict=True) if name not in ("shard", "slot", "law")]
    return shuffled(df, keys, seed, bucket_bytes, bucket_rows).select(*carried, *added)


def with_sizes(docs: DataFrame) -> DataFrame:
    """Adds size (UTF-8 bytes and 1) and the text's checksum."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})


def write_shards(df: DataFrame, path: str, keys: list[str], shards: int = 8, seed: int = 0, bucket_bytes: int = 128 << 20) -> None:
    """Writes whole records as Parquet, a folder for each shard, in slot order within a file.

    A task writes its runs of the order, so a shard has a file for each task; larger
    buckets make larger files.
    """
    out = sharded(df, keys, shards, seed, bucket_bytes)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document, whole, shuffled and written; its shard and slot under the law of equal counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = with_sizes(sharded(docs, ["doc_id"], 8, seed=1))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
