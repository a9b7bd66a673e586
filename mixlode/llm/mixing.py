"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, -ln(u) / weight, with u from 52 bits of a
seeded MD5 hash (which other engines have too) and the weight its quality.  In a
source's key order, sizes are summed up to the token budget that is left after the
complete epochs; the document on which the budget ends is taken in part, so that sums
meet targets within rounding.

The order is never built.  The key range in which a source's budget ends is cut into
CELLS cells, whose sums, summed up, name the one in which it ends, and that one is cut
again, until a single key is left: rows below it are taken whole, rows above it not at
all.  Rows that share this key are numbered, in parts.

Defined cases: null text has size 0 and is taken 0 words of; a null source is a
source of its own, last in order; null ids and repeated rows count as rows, each
taken once per epoch and each by itself in the last; weights that are null count as
1, those below 0.001 as 0.001; an empty table gives an empty result; other columns
are ignored by the plan and carried by `taken`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mixlode.llm.common import numbered, stored

#: Cells that a key range is cut into.
CELLS = 1024
#: Labelled documents that are broadcast.
SMALL_LABELS = 250_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    """Maximal runs of other than space and 0x09-0x0D; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: list[float], share: float, cap: float) -> list[float]:
    """Target of each source: `share` of all words by weight, none above `cap` times its size, excess dealt again."""
    total = share * sum(n for _, n in sizes)
    left, free, out = total, set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > cap * sizes[i][1]}
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i][1]
            left -= out[i]
        free -= full
    return out


def sampling_key(seed: int = 0) -> Column:
    """The exponential key of a row (doc_id, size, quality)."""
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / F.greatest(F.coalesce("quality", F.lit(1.0)), F.lit(1e-3))


@dataclass(frozen=True)
class Share:
    """What is taken of a source: `epochs` times all; once more what has keys below `key`, and up to `left` words of the `rows` rows at it."""

    source: str | None
    size: int
    target: float
    epochs: int
    key: float | None = None
    left: int = 0
    rows: int = 0


_SHARE = "__s string, source_size long, target double, epochs long, __edge double, __left long, __rows long"


def plan(keyed: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> list[Share]:
    """The shares of the sources of keyed (source, size, key), a stored table; weights repeat over the sources in code point order."""
    spark = keyed.sparkSession
    found = keyed.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))  # UTF-8 order is code point order
    goal = targets([(r["source"], r["size"]) for r in found], [float(weights[i % len(weights)]) for i in range(len(found))], share, cap)
    shares, ranges = [], {}
    for r, t in zip(found, goal, strict=True):
        whole = round(t)
        epochs = min(whole // r["size"], int(cap)) if r["size"] else 0
        shares.append(Share(r["source"], r["size"], float(t), epochs))
        if rest := whole - epochs * r["size"]:
            ranges[r["source"]] = (r["low"], r["high"], rest, r["n"])
    while wide := [(s, *r[:3]) for s, r in ranges.items() if r[0] < r[1]]:
        bounds = F.broadcast(spark.createDataFrame(wide, "s string, low double, high double, rest long"))  # one row a source
        inside = keyed.join(bounds, F.col("source").eqNullSafe(F.col("s")) & F.col("key").between(F.col("low"), F.col("high")))
        cell = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS), F.lit(CELLS - 1))
        cells = inside.groupBy("source", cell.alias("cell"), "rest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        ends = cells.withColumn("sum", F.sum("size").over(upto)).where((F.col("sum") >= F.col("rest")) & (F.col("sum") - F.col("size") < F.col("rest")))
        for r in ends.collect():  # one cell a source
            ranges[r["source"]] = (r["low"], r["high"], r["rest"] - (r["sum"] - r["size"]), r["n"])
    return [replace(s, key=ranges[s.source][0], left=ranges[s.source][2], rows=ranges[s.source][3]) if s.source in ranges else s for s in shares]


def around_edges(keyed: DataFrame, shares: list[Share]) -> tuple[DataFrame, DataFrame]:
    """The rows of keyed (source, key, ...) up to the key at which their source's budget ends, and those from it on; rows at it are in both."""
    bounds = keyed.sparkSession.createDataFrame([(s.source, s.key) for s in shares], "__s string, __edge double")
    placed = keyed.join(F.broadcast(bounds), F.col("source").eqNullSafe(F.col("__s")))  # one row a source
    return placed.where("key <= __edge").select(*keyed.columns), placed.where("__edge is null or key >= __edge").select(*keyed.columns)


def taken(rows: DataFrame, shares: list[Share], cut: bool = True) -> DataFrame:
    """Adds source_size, target, epochs (complete passes) and part (words of one more, partial pass) to rows (source, size, key, ...).

    With cut=False a part is all words or none: whole if the budget reaches the
    document's middle.  Rows are not shuffled, but for those that share the key at which
    their source's budget ends.
    """
    if not shares:
        return rows.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("epochs"), F.lit(0).cast("long").alias("part"))
    bounds = rows.sparkSession.createDataFrame([(s.source, s.size, s.target, s.epochs, s.key, s.left, s.rows) for s in shares], _SHARE)
    # one row a source: a few hundred bytes each, as many as the mix lists
    placed = rows.join(F.broadcast(bounds), F.col("source").eqNullSafe(F.col("__s")))

    def with_part(df: DataFrame, before: Column) -> DataFrame:
        reach = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - before))
        part = reach if cut else F.when((reach > 0) & (2 * reach >= F.col("size")), F.col("size")).otherwise(F.lit(0))
        part = F.when(F.col("key") < F.col("__edge"), F.col("size")).when(F.col("key") == F.col("__edge"), part).otherwise(F.lit(0))
        return df.select(*rows.columns, "source_size", "target", "epochs", part.cast("long").alias("part"))

    if all(s.rows <= 1 for s in shares):
        return with_part(placed, F.lit(0))
    tie = F.coalesce((F.col("key") == F.col("__edge")) & (F.col("__rows") > 1), F.lit(False))
    tied = numbered(placed.where(tie), ["source"], "__i")  # equal keys: rows of one size
    return with_part(placed.where(~tie), F.lit(0)).unionByName(with_part(tied, F.col("__i") * F.col("size")))


def mixed(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, name: str = "mix", cut: bool = True) -> DataFrame:
    """rows (doc_id, source, size, quality) -> doc_id, source, size, source_size, target, taken, epochs, part."""
    keyed = stored(rows.select("doc_id", "source", "size", sampling_key(seed).alias("key")), f"{name}-keys")
    both = taken(keyed, plan(keyed, weights, share, cap), cut)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part")


def with_quality(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds size and quality: 0.5 plus the mean quality label, 1 where there is none.

    Up to SMALL_LABELS labelled documents are broadcast (8 MB); more are joined by a
    shuffle, which rows without id do not enter, as no label is theirs.
    """
    rows = docs.withColumn("size", n_words())
    if labels is None:
        return rows.withColumn("quality", F.lit(1.0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__d")).agg((F.avg("quality") + 0.5).alias("__q"))
    quality = F.coalesce("__q", F.lit(1.0)).alias("quality")
    columns = [c for c in rows.columns if c != "quality"]
    same = F.col("doc_id") == F.col("__d")
    if labels.count() <= SMALL_LABELS:
        return rows.join(F.broadcast(marks), same, "left").select(*columns, quality)
    found = rows.where("doc_id is not null").join(marks.hint("merge"), same, "left").select(*columns, quality)
    return found.unionByName(rows.where("doc_id is null").select(*columns, F.lit(1.0).alias("quality")))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: what the mix takes of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixed(with_quality(docs.select("doc_id", "source", "text"), labels), seed=2).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in SQL.  Sources fill up in the order of size by weight; the first that does not sets the unit of all that follow.
SQL = r"""WITH q AS (SELECT doc_id, avg(quality) + 0.5 AS quality FROM labels GROUP BY doc_id),
d AS (SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(quality, 1.0) AS quality FROM documents LEFT JOIN q USING (doc_id)),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('2|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), 1, 13) AS BIGINT) + 1) / CAST(4503599627370496 AS DOUBLE)) / greatest(quality, 0.001) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
f AS (SELECT *, row_number() OVER o AS i, 1.5 * sum(n) OVER () - 2.0 * (sum(n) OVER o - n) AS free, sum(w) OVER () - (sum(w) OVER o - w) AS weights FROM s WINDOW o AS (ORDER BY n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, CAST(free AS DOUBLE) / weights AS unit, min(CASE WHEN CAST(free AS DOUBLE) / weights * w > 2 * n THEN NULL ELSE i END) OVER () AS stop FROM f),
t AS (SELECT source, n, CASE WHEN stop IS NULL OR i < stop THEN CAST(2 * n AS DOUBLE) ELSE max(CASE WHEN i = stop THEN unit END) OVER () * w END AS target FROM u),
e AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS whole, CASE WHEN n = 0 THEN 0 ELSE least(CAST(round_even(target, 0) AS BIGINT) // n, 2) END AS epochs FROM t),
a AS (SELECT k.doc_id, k.size, e.n, e.target, e.epochs, e.whole - e.epochs * e.n AS rest, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS start FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM a"""
