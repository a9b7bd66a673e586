"""Best-fit packing of tokenised documents into sequences of fixed length.

Packing needs only how many pieces there are of each length, so the plan is made
on that histogram (one number per length up to the capacity, whatever the size of
the corpus), and pieces are dealt to it by their rank among those of their length.

The plan: pieces above a third of the capacity share a sequence with one other of
them at most; each, longest first, is matched with the longest that fits.  Shorter
pieces, longest first, go to the smallest remaining gap that holds them, or open a
new sequence.

Defined cases: null and empty texts are one piece that holds the end token only; a
longer document than the capacity is cut into pieces of full length behind a
first, shorter one; repeated rows and null ids are pieces of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlode.llm.common import numbered, small_batches, stored

#: Words that each generation of a worker's memory holds, and characters of one (some 60 MB in all).
MEMORY, LONGEST = 200_000, 64
_TWO_BLANKS = re.compile(r"\s\s")
_encoders: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, as the library gives them for `json_file`.

    Words behind a single space always begin a token of their own, so their ids
    are kept between texts, in two generations of bounded size.  Texts with longer
    runs of white space go whole through the rank file's splitter, and texts with
    special strings through the library.
    """

    def __init__(self, json_file: str, rank_file: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.json_file, self.library = json_file, None
        self.whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # without its look-ahead, which only matters in runs of white space, the splitter is faster
        self.word = tiktoken.Encoding("word", pat_str=public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes() if array("I").itemsize != 4 or np.little_endian is False else array("I", ids).tobytes()

    def _recall(self, word: str) -> bytes:
        if len(word) > LONGEST:
            return self.packed(self.word.encode_ordinary(" " + word))
        got = self.old.get(word)
        if got is None:
            got = self.packed(self.word.encode_ordinary(" " + word))
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got

    def text(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.library is None:  # rarely needed, and large
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.json_file)
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        if _TWO_BLANKS.search(text):
            return self.packed(self.whole.encode_ordinary(text))
        first, *words = text.split(" ")
        parts = list(map(self.young.get, words))
        if None in parts:
            parts = [self._recall(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        return self.packed(self.whole.encode_ordinary(first)) + b"".join(parts)


def encoder(json_file: str, rank_file: str) -> Encoder:
    """This process's encoder for these files."""
    key = (json_file, rank_file)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def pieces(docs: DataFrame, json_file: str, rank_file: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with ids=True the ids) of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_file, rank_file).text
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = encode(text) + stop if text else stop
                n = len(data) // 4
                first = n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                for i, (a, z) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    part = data[4 * a : 4 * z]
                    for c, v in zip(cols, (key, i, a, z - a, zlib.crc32(part), part), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            take = 6 if ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:take], kinds, strict=False)], names[:take])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Plan:
    """Where the r-th piece of each length goes: runs of ranks to runs of sequences at an offset."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.left = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            if not 0 < size <= capacity:
                raise ValueError(f"length {size} is not between 1 and {capacity}")
            self.left[size] = n
        self.rank = np.zeros(capacity + 1, np.int64)
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        third = capacity // 3
        for size in range(capacity, third, -1):
            self._match(size, third)
        for size in range(third, 0, -1):
            self._fit(size)

    def _new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, size: int, n: int, first: int, offset: int) -> None:
        self.runs.append((size, int(self.rank[size]), first, offset))
        self.rank[size] += n
        self.left[size] -= n

    def _keep(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            self.gaps[gap].append((first, n))
            self.open[gap] += n

    def _match(self, size: int, third: int) -> None:
        while self.left[size]:
            partners = np.flatnonzero(self.left[third + 1 : min(size, self.capacity - size) + 1])
            other = third + 1 + int(partners[-1]) if len(partners) else 0
            if other == size and self.left[size] == 1:
                other = third + 1 + int(partners[-2]) if len(partners) > 1 else 0
            n = int(self.left[size]) if not other else int(self.left[size]) // 2 if other == size else int(min(self.left[size], self.left[other]))
            first = self._new(n)
            self._put(size, n, first, 0)
            if other:
                self._put(other, n, first, size)
            self._keep(self.capacity - size - other, first, n)

    def _fit(self, size: int) -> None:
        while self.left[size]:
            ready = np.flatnonzero(self.open[size:])
            if len(ready):
                gap = size + int(ready[0])
                first, n = self.gaps[gap].pop()
                use = int(min(n, self.left[size]))
                self.open[gap] -= n
                self._keep(gap, first + use, n - use)
                self._put(size, use, first, self.capacity - gap)
                self._keep(gap - size, first, use)
                continue
            each = self.capacity // size
            full, rest = divmod(int(self.left[size]), each)
            for n, items in ((full, each), (min(1, rest), rest)):
                if n:
                    first = self._new(n)
                    for j in range(items):
                        self._put(size, n, first, j * size)
                    self._keep(self.capacity - items * size, first, n)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length and first rank), first ranks, first sequences, offsets."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 4)
        return (runs[:, 0] << 48) + runs[:, 1], runs[:, 1].copy(), runs[:, 2].copy(), runs[:, 3].copy()


def packed(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (they are read more than once)."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    plan = Plan(counts, capacity)
    if not counts:
        return parts.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    ranked = numbered(parts, ["length"], "__r")
    at, ranks, firsts, offsets = plan.arrays()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__r"))
            i = np.searchsorted(at, (length << 48) + rank, side="right") - 1
            cols = [b.column(j) for j, c in enumerate(b.schema.names) if c != "__r"]
            names = [c for c in b.schema.names if c != "__r"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(firsts[i] + rank - ranks[i]), pa.array(offsets[i])], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {t}" for c, t in ranked.drop("__r").dtypes)
    return ranked.mapInArrow(deal, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its ids (binary), from packed pieces with ids; a sequence is bounded by the capacity."""
    held = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return held.select("sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: every piece of every document and its place."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = stored(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")), "packing-pieces")
    return packed(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
