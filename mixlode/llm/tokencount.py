"""Token counts by byte-pair merging with a heap and a linked list.

A text is split where no merge can cross (before each run of the space mark that
follows another character).  A unit's symbols form a linked list; a heap holds the
adjacent pairs that the vocabulary can merge.  The pair of lowest rank (then the
leftmost) is popped again and again; stale entries are passed over.  The count is
the initial symbols minus the merges, where a character outside the vocabulary
counts as its UTF-8 bytes.  No identifiers are made.  Units repeat a lot, so their
counts are kept in two generations of bounded size.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mixlode.llm.common import small_batches

MARK = "▁"
#: Units that each generation of a worker's memory holds, and characters of one (some 100 MB in all).
MEMORY, LONGEST = 400_000, 64
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
_counters: dict[str, Counter] = {}


class Counter:
    """Counts the tokens of texts for one piece vocabulary."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with the identity normalizer and a dummy prefix are counted")
        self.ranks = {p.piece: -p.score for p in proto.pieces if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not counted")
        if any(MARK in piece.lstrip(MARK) for piece in self.ranks):
            raise ValueError("a piece crosses a word boundary")
        self.bytes_fallback = proto.trainer_spec.byte_fallback
        self.library = sentencepiece
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Tokens of one unit: initial symbols minus merges."""
        ranks = self.ranks
        n = len(text)
        count = sum(1 if c in ranks or not self.bytes_fallback else len(c.encode("utf-8")) for c in text)
        if n < 2:
            return count
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := text[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, left, stop = heapq.heappop(heap)
            # stale: the left symbol is merged away or grown, or the pair now ends elsewhere
            if end[left] < 0:
                continue
            right = after[left]
            if right >= n or end[right] != stop:
                continue
            end[left], end[right] = stop, -1
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                if (p := text[left : end[nxt]]) in ranks:
                    heapq.heappush(heap, (ranks[p], left, end[nxt]))
            prev = before[left]
            if prev >= 0 and (p := text[prev:stop]) in ranks:
                heapq.heappush(heap, (ranks[p], prev, stop))
            count -= 1
        return count

    def _recall(self, unit: str) -> int:
        if len(unit) > LONGEST:
            return self.unit(unit)
        n = self.old.get(unit)
        if n is None:
            n = self.unit(unit)
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        self.young[unit] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        get, total = self.young.get, 0
        marked = MARK + text.replace(" ", MARK)
        for u in _UNITS.findall(marked):
            n = get(u)
            if n is None:
                n = self._recall(u)
                get = self.young.get
            total += n
        return total


def counter(model_file: str) -> Counter:
    """This process's counter for a vocabulary file."""
    if model_file not in _counters:
        _counters[model_file] = Counter(model_file)
    return _counters[model_file]


def counted(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file).text
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(t) if t else 0 for t in texts]
            size = [len(t.encode("utf-8")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract query: token counts of every document for piece_bpe_32k.model."""
    import public_tokenizers

    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
