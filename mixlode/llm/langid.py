"""Language identification by error-correcting output codes.

Every language has a codeword.  Each bit has a binary classifier over byte trigrams
(ASCII case folded, digits, punctuation and white space as one blank): the mean log
likelihood ratio of a text's trigrams between the languages with that bit set and
those without, calibrated by the training texts' means and variance.  Decoding adds up, over the bits, the
logistic loss of each codeword, weighted by the bits' reliability in training; the
nearest codeword wins.  The score is its share of exp(-loss); texts whose score is
below AMBIGUOUS are flagged.

Defined cases: null texts and texts without a letter are `und` with score 0, not
ambiguous; with one learned language all else is that one, with none `und`;
repeated rows give repeated results; an empty table gives an empty result; other
columns are carried by `identified` (those that clash with its results are replaced).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlode.llm.common import small_batches
from mixlode.llm.shingles import chunks, text_buffers

#: Cells of the trigram table, and a cell that counts for nothing.
CELLS = 1 << 15
#: Labelled texts of each language that a model is fitted on.
SAMPLE = 800
#: Bytes of labelled text of each language, beyond which no further text is taken: what the driver holds is this and one text a language.
SAMPLE_BYTES = 8 << 20
#: Scores below this are ambiguous.
AMBIGUOUS = 0.6
UND = "und"


def _fold() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint32)
    blank = (codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 128))
    return np.where(blank, 32, np.where((codes >= 65) & (codes <= 90), codes + 32, codes)).astype(np.uint32)


_FOLDED = _fold()


def trigram_cells(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: the cell of every trigram, and each row's bounds (n + 1).  Trigrams across rows have cell CELLS."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()).fill_null(""), pa.scalar("   ", pa.large_string()), pa.scalar("", pa.large_string()))
    offs, raw = text_buffers(spaced)
    for start, stop in chunks(offs):
        b = _FOLDED[raw[offs[start] : offs[stop]]]
        cell = b.copy()
        cell[:-2] = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        cell = ((cell * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)
        bounds = offs[start : stop + 1] - offs[start]
        for back in (1, 2):
            cell[bounds[1:] - back] = CELLS
        yield cell, bounds


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """(n, bits) of 1 and -1: exhaustive codes up to 7 languages, else the widest of 200 seeded random codes."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        rest = list(itertools.product((1, -1), repeat=n - 1))[1:]
        return np.array([[1] * len(rest), *zip(*rest, strict=True)], np.int8)
    rng, bits = np.random.default_rng(seed), min(64, int(np.ceil(10 * np.log2(n))))
    best, width = None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        split = (abs(code.sum(axis=0)) < n).all()
        if split and least > width:
            best, width = code, least
    return best


@dataclass(frozen=True)
class Model:
    """What prediction needs; small enough for a closure (CELLS x bits floats)."""

    languages: tuple[str, ...]
    code: np.ndarray
    table: np.ndarray  # (CELLS + 1, bits): log likelihood ratios
    slope: np.ndarray
    offset: np.ndarray
    weight: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """(rows, bits): each bit's mean ratio, scaled by the root of the number of trigrams up to 256."""
        out = []
        for cell, bounds in trigram_cells(texts):
            sums = np.add.reduceat(self.table[cell], bounds[:-1], axis=0)
            n = np.maximum(np.diff(bounds) - 2, 1)[:, None]
            out.append(sums / n * np.sqrt(np.minimum(n, 256)))
        return np.concatenate(out) if out else np.zeros((0, self.code.shape[1]))

    def decode(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its score."""
        margin = np.clip(evidence * self.slope + self.offset, -30, 30)
        loss = np.stack([(np.log1p(np.exp(-margin * c)) * self.weight).sum(axis=1) for c in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, share[np.arange(len(best)), best]


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model from labelled texts."""
    names = tuple(sorted(set(langs)))
    code = codewords(len(names))
    index = {n: i for i, n in enumerate(names)}
    label = np.array([index[x] for x in langs], np.int64)
    counts = np.zeros((len(names), CELLS + 1))
    column, row = pa.array(texts, pa.large_string()), 0
    for cell, bounds in trigram_cells(column):
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            # each text counts alike, so that long ones do not drown the rest
            counts[label[row]] += np.bincount(cell[a:z], minlength=CELLS + 1) / (z - a)
            row += 1
    counts[:, CELLS] = 0
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-12)
    table = np.zeros((CELLS + 1, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        sides = [share[code[:, bit] == s].sum(axis=0) / max(1, (code[:, bit] == s).sum()) for s in (1, -1)]
        table[:, bit] = np.log((sides[0] + 1e-6) / (sides[1] + 1e-6))
    table[CELLS] = 0
    ones = np.ones(code.shape[1])
    rough = Model(names, code, table, ones, 0 * ones, ones)
    z, truth = rough.evidence(column), code[label].astype(float)
    slope, offset, weight = ones.copy(), 0 * ones, ones.copy()
    for bit in range(code.shape[1]):
        up, down = z[truth[:, bit] > 0, bit], z[truth[:, bit] < 0, bit]
        if not len(up) or not len(down):
            continue
        # the log odds of two normal distributions of one variance
        spread = max(1e-3, (up.var() * len(up) + down.var() * len(down)) / len(z))
        a = min(4.0, max(1e-3, (up.mean() - down.mean()) / spread))
        c = -a * (up.mean() + down.mean()) / 2
        slope[bit], offset[bit] = a, c
        weight[bit] = max(0.0, 2 * ((a * z[:, bit] + c) * truth[:, bit] > 0).mean() - 1)
    return Model(names, code, table, slope, offset, weight / max(weight.sum(), 1e-9) * len(weight))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, per_language: int = SAMPLE, bytes_per_language: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """Whole texts (text, lang) chosen by a hash of the id: of each language per_language at most, and no further one beyond bytes_per_language."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return []
    u = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 1.2 * per_language / n)])
    near = usable.withColumn("u", u).where(F.col("u") < limits[F.col("lang")])
    # first who they are and how long, then the texts of those that are taken
    listed = near.select("u", "doc_id", "lang", F.octet_length("text").alias("n"), F.xxhash64("text").alias("t")).orderBy("u", "doc_id", "t").limit(2 * per_language * len(counts)).collect()
    kept, size, chosen = dict.fromkeys(counts, 0), dict.fromkeys(counts, 0), set()
    for r in listed:
        lang = r["lang"]
        if kept[lang] < per_language and size[lang] < bytes_per_language:
            kept[lang], size[lang] = kept[lang] + 1, size[lang] + r["n"]
            chosen.add((r["doc_id"], r["t"], lang))
    same = near.where(F.col("doc_id").isin(sorted({k[0] for k in chosen}))).select("doc_id", F.xxhash64("text").alias("t"), "lang", "text")
    found = same.dropDuplicates(["doc_id", "t", "lang"]).orderBy("doc_id", "t", "lang").collect()
    return [(r["text"], r["lang"]) for r in found if (r["doc_id"], r["t"], r["lang"]) in chosen]


def _lettered(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter."""
    plain = pc.match_substring_regex(texts, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~plain):
        t = texts[int(i)].as_py()
        plain[i] = t is not None and any(c.isalpha() for c in t)
    return plain


def identified(docs: DataFrame, model: Model | None, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """Adds lang_pred, score and ambiguous to every row."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            letters = _lettered(texts)
            pred = np.full(b.num_rows, UND, dtype=object)
            score = np.zeros(b.num_rows)
            if model is not None and letters.any():
                best, share = model.decode(model.evidence(texts))
                pred = np.where(letters, np.array(model.languages, dtype=object)[best], UND)
                score = np.where(letters, share, 0.0)
            doubt = letters & (score < ambiguous) if model is not None else np.zeros(b.num_rows, bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(doubt)], [*b.schema.names, "lang_pred", "score", "ambiguous"])

    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")


def trained(docs: DataFrame, per_language: int = SAMPLE) -> Model | None:
    sample = training_sample(docs, per_language)
    return fit(*map(list, zip(*sample, strict=True))) if sample else None


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's predicted language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identified(docs.select("doc_id", "text"), trained(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
