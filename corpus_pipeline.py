"""The corpus pipeline: language ID, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlode.llm import jaccard, langid, mixing, packing
from mixlode.llm.common import sides, small_batches, stored, told


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is ambiguous; trains on `docs`.

    Null and empty texts have no letter and go; other columns are carried whatever their
    names, and repeated rows stay repeated.  Without any labelled row nothing can be told
    apart, and every document goes.
    """
    model = langid.trained(docs)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("r")
    found = langid.identified(docs.select("text", rest), model).where((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous"))
    return found.select(*[F.col("text") if c == "text" else F.col(f"r.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group (five words, Jaccard 0.8).

    A document is known by its id and its text's hash, so that null ids, and rows that
    repeat an id with another text, stand for themselves.  Rows equal in both are one
    document, and the row that orders first stays; texts without words are in no group
    and all stay.  Filters of the decisions' keys tell what stays from what goes; only
    texts of which they are not sure, and those of repeated rows, are shuffled.
    """
    found = stored(jaccard.first_of_component(docs, width=5, num=80, den=100, name="pipeline-jaccard"), "pipeline-groups")
    own = F.expr("doc_id <=> component_id and text_key = component_key")
    same = found.groupBy("doc_id", "text_key").agg(F.when(F.max("n_shingles") > 0, F.struct(F.first(own).alias("first"), F.count(F.lit(1)).alias("n"))).alias("v"))
    # narrow: of each document whether it stays, and how many rows it has; texts without words stay with all theirs
    verdicts = stored(same.select("doc_id", "text_key", F.xxhash64("doc_id", "text_key").alias("key"), F.coalesce("v.first", F.lit(True)).alias("first"), F.coalesce("v.n", F.lit(1)).alias("n")), "pipeline-verdicts")
    filters = sides(verdicts.where("not first or n > 1"), verdicts.where("first"), "pipeline-verdicts")
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), F.struct("*").alias("r"))
    unsure = told(keyed, filters, sure=False).select(F.xxhash64("r.text").alias("t"), "r")
    least = told(verdicts, filters, sure=False).drop("key", "told").hint("merge")
    decided = unsure.join(least, F.col("r.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_key"))).where("first").select("t", "r", "n")
    once = decided.where("n > 1").groupBy("r.doc_id", "t").agg(F.min("r").alias("r"))
    return told(keyed, filters).where("not told").select("r.*").unionByName(decided.where("n = 1").select("r.*")).unionByName(once.select("r.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; the last, partial pass takes it whole from its middle on.

    Null ids and repeated rows are rows of their own; texts without words have no size,
    and the mix takes none of them.  The plan reads narrow keys.  Where labels are too
    many for a broadcast, filters of the rows that the last pass takes tell these from the
    others; only documents of which they are not sure, and those at which a source's
    budget ends, are shuffled.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    def rows_of(df: DataFrame) -> DataFrame:
        sized = mixing.with_quality(df, labels)
        return sized.select("doc_id", "source", "size", mixing.sampling_key(2).alias("key"), *[c for c in df.columns if c == "r"])

    def times(last: Column) -> Column:
        return F.when(F.col("size") > 0, F.col("epochs") + last.cast("long")).otherwise(0).cast("int").alias("times")

    # what a row's passes depend on
    row_key = F.xxhash64("doc_id", "source", "size")
    whole = docs.select("doc_id", "source", "text", F.struct("*").alias("r"))
    keys = stored(rows_of(docs.select("doc_id", "source", "text")).select("source", "size", "key", row_key.alias("row_key")), "pipeline-mix-keys")
    shares = mixing.plan(keys)
    if not shares or labels.count() <= mixing.SMALL_LABELS:
        taken = mixing.taken(rows_of(whole), shares, cut=False).select("r", times(F.col("part") > 0))
    else:
        filters = sides(*[df.select(F.col("row_key").alias("key")) for df in mixing.around_edges(keys, shares)], "pipeline-mix")
        keyed = whole.withColumn("size", mixing.n_words()).select(row_key.alias("key"), "source", "size", "r")
        passes = spark.createDataFrame([(s.source, s.epochs) for s in shares], "__s string, epochs long")
        # one row a source
        sure = told(keyed, filters).join(F.broadcast(passes), F.col("source").eqNullSafe(F.col("__s"))).select("r", times(F.col("told")))
        rest = rows_of(told(keyed, filters, sure=False).select("r.doc_id", "r.source", "r.text", "r"))
        taken = sure.unionByName(mixing.taken(rest, shares, cut=False).select("r", times(F.col("part") > 0)))
    return taken.where("times > 0").select("r", F.explode(F.sequence(F.lit(1), F.col("times")))).select("r.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document; null and empty texts are one piece that holds the end token only."""
    import public_tokenizers

    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.packed(stored(parts, "pipeline-pieces"))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Sampling by hashes, trained models and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
