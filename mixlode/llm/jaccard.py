"""N-gram Jaccard join with set-relation skipping; near-duplicate components.

Two texts link when their shingle sets' intersection is at least num/den of their
union.  The join is exact (up to collisions of 64-bit hashes).

1. Every text gives its set's size and signature; equal sets are one set from here
   on.  A sketch of fixed size counts, over all texts, how many sets a shingle's
   cell occurs in; its levels order the shingles, rare ones first.
2. A set is indexed under its prefix: the shingles of which two linked sets must
   share one.  Index lists are sorted by set size and position.  In a list, a block
   is the sets of one size; the two sizes of a pair of blocks give the last position
   from which the required overlap can still be reached, and all entries behind it
   are skipped at once.  Two sets of a list are candidates unless their parity maps
   (see `parities`) rule out a link, so texts that share a passage only are no candidates,
   however many they are.  Short lists give pairs, which meet their maps; in lists of more
   than LONG entries the entries do.  Hot lists are split by a salt, reduced to one entry
   for each size and position, and only these meet; what remains of two blocks there is
   joined entry by entry, not pair by pair, and without maps.  Candidates that hang
   together are a cluster.
3. Sets of a cluster are compared.  A set's answers (its overlaps with all others) are
   derived from the computed answers of the set most like it, by the index lists of the
   few shingles in which the two differ; see `linked`.
   Clusters above BLOCK sets are cut into blocks, compared within two independent
   cuts; then the sets outside a cluster's main component are compared with all sets
   of the cluster, so that no link between different components is missed.

Defined cases: null texts and texts without words have the empty set, link with
nothing and are their own component; texts with fewer than `width` words have one
shingle; repeated rows and rows that repeat an id are rows of their own, and the
component is the smallest id reached (null only if all ids are null); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlode.llm.common import components, key_bits, selected, small_batches, stored
from mixlode.llm.shingles import mix64, shingle_sets

#: Sets, and shingles, of one block of a cluster: what one task holds at a time.
BLOCK = 512
BLOCK_SHINGLES = 2_000_000
#: Cells of the frequency sketch, and of one of its slices.
CELL_BITS, SLICE_BITS = 20, 16
#: Entries of a list up to which it gives pairs.
LONG = 16
#: A list is hot from this count on, whatever the size of the corpus.
HOT = 4096
SALTS = 64
#: Postings that a task hands over at a time.
SLICE_ROWS = 1 << 16


def needed(a, b, num: int, den: int):
    """Least intersection with which sets of sizes a and b link."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def signature(hashes: np.ndarray) -> int:
    """A set's 64-bit name (signed); 0 for the empty set."""
    if not len(hashes):
        return 0
    total = np.array([mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix64(hashes + np.uint64(len(hashes))))])
    return int(mix64(total).view(np.int64)[0])


def parities(s: np.ndarray) -> bytes:
    """A set's parity map: for each of a power of two of places, at least one a shingle, whether an odd number of shingles falls there.

    Two maps differ in no more places than their sets in shingles.
    """
    places = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(bool), bitorder="little").tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity maps (rows of 64-bit words) on fewer places."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def may_link(a: np.ndarray, maps_a: np.ndarray, b: np.ndarray, maps_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes and parity maps, row by row, can have the overlap that they need to link."""
    words = min(maps_a.shape[1], maps_b.shape[1])
    apart = np.bitwise_count(folded(maps_a, words) ^ folded(maps_b, words)).sum(axis=1, dtype=np.int64)
    return apart <= a + b - 2 * needed(a, b, num, den)


def _maps(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u8").reshape(len(blobs), -1)


def _summaries(width: int) -> Callable:
    cells, piece = 1 << CELL_BITS, 1 << SLICE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(cells, np.int64), set()

        def batch(ids, keys, sizes, sids, blobs):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())], ["id", "text_key", "n", "sid", "bits"])

        for b in batches:
            sizes, sids, maps = [], [], []
            for s in shingle_sets(b.column(2), width):
                sizes.append(len(s))
                sids.append(name := signature(s))
                maps.append(parities(s) if len(s) else None)
                if len(s) and name not in seen:  # copies in one task count once
                    seen.add(name)
                    np.add.at(sketch, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
            yield batch(b.column(0), b.column(1), sizes, sids, maps)
        if seen:
            for i in range(cells // piece):
                part = sketch[i * piece : (i + 1) * piece]
                yield batch([None], [i], [-1], [0], [zlib.compress(part.astype("<u4").tobytes(), 1)])

    return run


def _merged_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch's slices; a task keeps the slices it meets, 2^16 cells each."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for i, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(blob.as_py()), "<u4").astype(np.int64)
            held[i] = held[i] + part if i in held else part
    if held:
        blobs = [zlib.compress(v.astype("<i8").tobytes(), 1) for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blobs, pa.binary())], ["slice", "cells"])


def levels_of(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint8 levels of cells by their counts, and whether a cell is hot.

    In a large corpus every cell counts many rare shingles.  What a cell holds above the
    usual is what its frequent shingles add, so levels (4 times a binary log) and the hot
    limit are taken above a low cell and the middle cell, with room for the middle's noise.
    """
    low, middle = np.quantile(total, (0.01, 0.5))
    return (4 * np.log2(np.maximum(total - low, 0) + 1)).astype(np.uint8), total - middle >= HOT + 4 * np.sqrt(middle)


def frequency_levels(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """levels_of all cells of the sketch."""
    parts = summaries.where("n = -1").select(F.col("text_key").alias("slice"), F.col("bits").alias("cells"))
    total = np.zeros(1 << CELL_BITS, np.int64)
    merged = parts.repartition(16, "slice").mapInArrow(_merged_slices, "slice long, cells binary")
    for r in merged.toLocalIterator():  # 16 slices of 2^16 cells
        total[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] += np.frombuffer(zlib.decompress(r["cells"]), "<i8")
    return levels_of(total)


def _postings(levels: np.ndarray, hot: np.ndarray, width: int, num: int, den: int) -> Callable:
    packed_hot = np.packbits(hot)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())

    def batch(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], ["h", "salt", "n", "pos", "sid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_hot, seen = np.unpackbits(packed_hot).astype(bool), set()
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            held = 0
            for s in shingle_sets(b.column(0), width):
                n = len(s)
                if not n or (name := signature(s)) in seen:
                    continue
                seen.add(name)
                cell = (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                p = prefix_length(n, num, den)
                order = np.argsort((levels[cell].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[:p]
                salt = np.where(is_hot[cell[order]], 1 + (name & 0xFFFFFFFF) % SALTS, 0)
                for c, v in zip(cols, (s[order].view(np.int64), salt, np.full(p, n), np.arange(p), np.full(p, name)), strict=True):
                    c.append(v)
                held += p
                if held >= SLICE_ROWS:
                    yield batch(cols)
                    cols, held = [[] for _ in range(5)], 0
            if held:
                yield batch(cols)

    return run


def join_list(n: np.ndarray, pos: np.ndarray, sid: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Joins of one index list, sorted by size and position; linear in entries plus pairs of sizes."""
    starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
    stops, sizes = np.r_[starts[1:], len(n)], n[starts].tolist()
    reach = starts.copy()  # entries of a block up to here are joined with its first
    parent = list(range(len(n)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    def join_up_to(block: int, stop: int) -> None:
        for i in range(max(int(reach[block]), int(starts[block]) + 1), stop):
            union(int(starts[block]), i)
        reach[block] = max(reach[block], stop)

    def within(block: int, need: int) -> int:
        """End of the entries from whose position the overlap can still be reached."""
        a, z = int(starts[block]), int(stops[block])
        return a + int(np.searchsorted(pos[a:z], sizes[block] - need, side="right"))

    for y in range(len(sizes)):
        for x in range(y, -1, -1):
            if den * sizes[x] < num * sizes[y]:
                break
            need = needed(sizes[x], sizes[y], num, den)
            ex, ey = within(x, need), within(y, need)
            if x == y:
                if ex - starts[x] > 1:
                    join_up_to(x, ex)
            elif ex > starts[x] and ey > starts[y]:
                join_up_to(x, ex)
                join_up_to(y, ey)
                union(int(starts[x]), int(starts[y]))
    return [(int(sid[find(i)]), int(sid[i])) for i in range(len(n)) if find(i) != i]


def list_pairs(n: np.ndarray, pos: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one short index list, sorted by size, that can still reach their overlap."""
    i, j = np.triu_indices(len(n), 1)
    need = needed(n[i], n[j], num, den)
    ok = (den * n[i] >= num * n[j]) & (n[i] - pos[i] >= need) & (n[j] - pos[j] >= need)
    return i[ok], j[ok]


def _joined(num: int, den: int, reduced: bool = False) -> Callable:
    """Streams sorted postings; yields candidates (a, b), and entries of long and hot lists that have yet to meet.

    Of hot lists one entry for each size and position is left, with which the others are
    united; so are, in `reduced` lists, all entries that can still reach their overlap.
    """
    names = ["a", "b", "united", "h", "salt", "n", "pos", "sid"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())

    def batch(*cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def lists(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h, salt, n, pos, sid = cols
            new = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
            starts = np.flatnonzero(new)
            lengths = np.diff(np.r_[starts, len(h)])
            pairs: set[tuple[int, int]] = set()
            united: set[tuple[int, int]] = set()
            later: list[np.ndarray] = []
            plain = salt[starts] == 0
            if reduced:
                for s, k in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
                    united.update(join_list(n[s : s + k].astype(np.int64), pos[s : s + k], sid[s : s + k], num, den))
            else:
                two = starts[plain & (lengths == 2)]
                if len(two):
                    small, large = n[two].astype(np.int64), n[two + 1].astype(np.int64)
                    need = needed(small, large, num, den)
                    ok = (den * small >= num * large) & (small - pos[two] >= need) & (large - pos[two + 1] >= need)
                    pairs.update(zip(sid[two[ok]].tolist(), sid[two[ok] + 1].tolist(), strict=True))
                short = plain & (lengths > 2) & (lengths <= LONG)
                for s, k in zip(starts[short].tolist(), lengths[short].tolist(), strict=True):
                    i, j = list_pairs(n[s : s + k].astype(np.int64), pos[s : s + k], num, den)
                    pairs.update(zip(sid[s + i].tolist(), sid[s + j].tolist(), strict=True))
                long = np.repeat(plain & (lengths > LONG), lengths)
                if long.any():
                    later.append(np.flatnonzero(long))
                salted = np.flatnonzero(salt > 0)
                if len(salted):
                    first = new | np.r_[True, (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])]
                    leader = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
                    other = salted[leader[salted] != salted]
                    united.update(zip(sid[leader[other]].tolist(), sid[other].tolist(), strict=True))
                    later.append(salted[first[salted]])
            for edges, together in ((pairs, False), (united, True)):
                if edges := [(min(e), max(e)) for e in edges if e[0] != e[1]]:
                    none = [None] * len(edges)
                    yield batch(*zip(*edges, strict=True), [together] * len(edges), *[none] * 5)
            for at in later:
                none = [None] * len(at)
                yield batch(none, none, none, h[at], salt[at], n[at], pos[at], sid[at])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield from lists([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
        if rest is not None and len(rest[0]):
            yield from lists(rest)

    return run


def _close(num: int, den: int) -> Callable:
    """Of pairs (a, b, na, nb, ma, mb) those whose parity maps let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            ma, mb = (b.column(i).to_pylist() for i in (4, 5))
            kind = np.array([len(x) << 32 | len(y) for x, y in zip(ma, mb, strict=True)], np.int64)
            keep = np.zeros(len(kind), bool)
            for k in np.unique(kind).tolist():
                at = np.flatnonzero(kind == k)
                for part in np.array_split(at, -(-len(at) * (k >> 32) // (8 << 20)) or 1):
                    keep[part] = may_link(na[part], _maps([ma[i] for i in part]), nb[part], _maps([mb[i] for i in part]), num, den)
            if keep.any():
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def meet_list(n: np.ndarray, pos: np.ndarray, sid: list[int], blobs: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Candidates of one index list, sorted by size, that connect what its pairs of candidates connect."""
    size = np.array([len(x) for x in blobs])
    maps = {k: _maps([x for x in blobs if len(x) == k]) for k in set(size.tolist())}
    index = np.zeros(len(n), np.int64)
    for k in maps:
        index[size == k] = np.arange((size == k).sum())
    root, edges = np.arange(len(n)), []
    for y in range(1, len(n)):
        low = int(np.searchsorted(n, -(-num * int(n[y]) // den)))
        need = needed(n[low:y], n[y], num, den)
        ok = (n[low:y] - pos[low:y] >= need) & (n[y] - pos[y] >= need)
        xs = low + np.flatnonzero(ok)
        own = maps[int(size[y])][index[y]][None, :]
        for k in np.unique(size[xs]).tolist():
            at = xs[size[xs] == k]
            at = at[may_link(n[at], maps[k][index[at]], n[y], own, num, den)]
            for r in np.unique(root[at]).tolist():
                edges.append((sid[int(at[root[at] == r][0])], sid[y]))
                root[root == r] = root[y]
    return edges


def _met(num: int, den: int) -> Callable:
    """Streams (h, n, pos, sid, bits) sorted by h and n; yields the candidates (a, b) of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def edges() -> pa.RecordBatch:
            _, n, pos, sid, blobs = zip(*held, strict=True)
            found = meet_list(np.array(n, np.int64), np.array(pos, np.int64), list(sid), list(blobs), num, den)
            return pa.RecordBatch.from_arrays([pa.array([f(e) for e in found], pa.int64()) for f in (min, max)], ["a", "b"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and row[0] != held[0][0]:
                    yield edges()
                    held = []
                held.append(row)
        if held:
            yield edges()

    return run


def clusters(texts: DataFrame, maps: DataFrame, levels: np.ndarray, hot: np.ndarray, width: int, num: int, den: int, name: str) -> DataFrame:
    """(sid, cluster) of the sets that may link with another; maps: (sid, n, bits) of all sets."""
    postings = texts.select("text").mapInArrow(_postings(levels, hot, width, num, den), "h long, salt int, n int, pos int, sid long")
    kinds = "a long, b long, united boolean, h long, salt int, n int, pos int, sid long"
    sort = ["h", "salt", "n", "pos", "sid"]
    first = stored(postings.repartition("h", "salt").sortWithinPartitions(*sort).mapInArrow(_joined(num, den), kinds), f"{name}-joins")
    # both sides of these joins grow with the corpus and are shuffled, whatever the size
    pairs = stored(first.where("not united").select("a", "b").distinct(), f"{name}-pairs")
    side = lambda c: maps.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"m{c}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    edges = stored(both.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_close(num, den), "a long, b long"), f"{name}-close")
    # an entry is there once for each task that met its set
    entries = first.where("salt = 0").select("h", "pos", "sid").distinct()
    long = entries.hint("merge").join(maps, "sid").select("h", "n", "pos", "sid", "bits").repartition("h").sortWithinPartitions("h", "n", "pos", "sid")
    edges = edges.union(stored(long.mapInArrow(_met(num, den), "a long, b long"), f"{name}-met"))
    if hot.any():
        again = first.where("salt > 0").select("h", F.lit(0).alias("salt"), "n", "pos", "sid")
        second = again.repartition("h").sortWithinPartitions(*sort).mapInArrow(_joined(num, den, reduced=True), kinds)
        edges = edges.union(first.where("united").select("a", "b")).union(second.where("united").select("a", "b"))
    return components(edges, f"{name}-clusters").select(F.col("node").alias("sid"), F.col("label").alias("cluster"))


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Label of each set: the least index of those it is connected with, by exact links.

    A set's answer is its overlap with every set.  The next set is always the one most
    like a set that has its answer, from which its own is derived: less the index lists of
    the shingles that only the other has, plus those of its own further ones.  A set that
    is like none is counted from its lists.  Taken in this order, a set that links with any
    earlier one links with the one it is derived from, so these links span the components.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    bounds, rank = np.r_[0, np.cumsum(sizes)], np.cumsum(count > 1) - 1
    shared = count[token] > 1
    held = [rank[token[a:z][shared[a:z]]] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    holder = np.repeat(np.arange(m, dtype=np.int32), sizes)[shared]
    holder = holder[np.argsort(rank[token[shared]], kind="stable")]
    ends = np.cumsum(count[count > 1])
    mark = np.zeros(len(ends), bool)

    def hits(tokens: np.ndarray) -> np.ndarray:
        """How many of these shingles' lists each set is in."""
        n = count_shared[tokens]
        at = np.repeat(ends[tokens] - np.cumsum(n), n) + np.arange(int(n.sum()))
        return np.bincount(holder[at], minlength=m)

    def without(tokens: np.ndarray, other: np.ndarray) -> np.ndarray:
        mark[other] = True
        rest = tokens[~mark[tokens]]
        mark[other] = False
        return rest

    count_shared = count[count > 1]
    answers: list[np.ndarray | None] = [None] * m
    todo, like, source, root = np.ones(m, bool), np.zeros(m), np.full(m, -1), np.arange(m)
    for _ in range(m):
        y = int(np.where(todo, like, -1.0).argmax())
        x = int(source[y])
        todo[y] = False
        gained, lost = (without(held[y], held[x]), without(held[x], held[y])) if x >= 0 else (held[y], held[y])
        answer = answers[y] = answers[x] + hits(gained) - hits(lost) if len(gained) + len(lost) < len(held[y]) else hits(held[y])
        if x >= 0 and den * answer[x] >= num * (sizes[x] + sizes[y] - answer[x]):
            root[y] = root[x]
        now = answer / (sizes + sizes[y] - answer)
        closer = todo & (now > like)
        like[closer], source[closer] = now[closer], y
    least = np.full(m, m)
    np.minimum.at(least, root, np.arange(m))
    return least[root]


def _compared(width: int, num: int, den: int) -> Callable:
    """Streams (g, sid, text) sorted by g; yields links (a, b) that span each group's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sids, texts = None, [], []

        def links() -> list[tuple[int, int]]:
            if len(sids) < 2:
                return []
            label = linked(list(shingle_sets(pa.array(texts, pa.large_string()), width)), num, den)
            return [(sids[x], sids[i]) for i, x in enumerate(label.tolist()) if x != i]

        def batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            edges: list[tuple[int, int]] = []
            for g, sid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != group:
                    edges += links()
                    group, sids, texts = g, [], []
                if not sids or sid not in (sids[-1],):
                    sids.append(sid)
                    texts.append(text)
            if edges:
                yield batch(edges)
        if edges := links():
            yield batch(edges)

    return run


def first_of_component(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, name: str = "jaccard") -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text_key, n_shingles, component_id, component_key.

    text_key is the text's hash; component_id and component_key name the component's
    first row: that of smallest id (null last), then of smallest text_key.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    summary = stored(keyed.mapInArrow(_summaries(width), "id long, text_key long, n long, sid long, bits binary"), f"{name}-sets")
    rows = summary.where("n >= 0").select(F.col("id").alias("doc_id"), "text_key", "n", "sid")
    levels, hot = frequency_levels(summary)
    maps = stored(summary.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), f"{name}-maps")
    member = clusters(texts, maps, levels, hot, width, num, den, name)

    # one row of each set that is in a cluster, and its block
    sets = rows.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("r"), F.first("n").alias("n"))
    member = stored(member.join(sets, "sid").select("sid", "cluster", "n", "r.doc_id", "r.text_key"), f"{name}-members")
    size = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = stored(member.join(size, "cluster"), f"{name}-blocks")
    # only texts that a filter of the members' keys lets through are shuffled
    bits = key_bits(member.select("text_key"))
    key = selected(keyed.select("doc_id", F.col("text_key").alias("key"), "text"), bits, once=["doc_id", "key"]).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "text")
    # the members grow with the corpus: both sides are shuffled, whatever the size
    found = key.hint("merge").join(member, key.d.eqNullSafe(member.doc_id) & (key.k == member.text_key)).select("sid", "cluster", "n", "blocks", "text")
    found = stored(found, f"{name}-texts")

    def compare(groups: DataFrame) -> DataFrame:
        """Links within groups, named by column g."""
        return groups.repartition("g").sortWithinPartitions("g", "n", "sid").select("g", "sid", "text").mapInArrow(_compared(width, num, den), "a long, b long")

    def cut(seed: int):
        return F.pmod(F.xxhash64(F.lit(seed), "sid"), F.col("blocks")).cast("int")

    group = F.xxhash64  # groups that share a hash by chance are compared together, which changes no link
    edges = stored(compare(found.select(group("cluster", cut(1)).alias("g"), "sid", "n", "text")), f"{name}-links-1")
    large = found.where("blocks > 1")
    if not large.isEmpty():
        second = stored(compare(large.select(group("cluster", cut(2)).alias("g"), "sid", "n", "text")), f"{name}-links-2")
        so_far = components(edges.union(second), f"{name}-parts")
        inside = large.select("sid", "cluster", "blocks").join(so_far.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "cluster", "blocks", F.coalesce("label", "sid").alias("label"))
        inside = stored(inside.distinct(), f"{name}-inside")
        main = inside.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max(F.struct("count", "label"))["label"].alias("main"))
        minor = inside.join(main, "cluster").where("label <> main").select("sid", "cluster")
        # the minor sets of a cluster, in chunks, each meet every block of it
        amount = minor.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
        targets = large.join(amount, "cluster").select("cluster", cut(1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "sid", "n", "text")
        probes = large.join(minor.join(amount, "cluster").select("sid", "chunks"), "sid").select(
            "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(3), "sid"), F.col("chunks")).cast("int").alias("chunk"), "sid", "n", "text",
        )
        meet = targets.unionByName(probes).select(group("cluster", "block", "chunk").alias("g"), "sid", "n", "text")
        edges = edges.union(second).union(stored(compare(meet), f"{name}-links-3"))

    label = components(edges, f"{name}-components").withColumnRenamed("node", "sid")
    named = sets.select("sid", "r").join(label, "sid", "left").select("sid", "r", F.coalesce("label", "sid").alias("label"))
    first = named.groupBy("label").agg(F.min("r").alias("first"))
    by_set = named.join(first, "label").select("sid", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    out = rows.join(by_set, "sid", "left")
    own = F.col("n") == 0
    return out.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"),
        F.when(own, F.col("text_key")).otherwise(F.col("first_key")).alias("component_key"),
    )


def set_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, name: str = "jaccard") -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    return first_of_component(docs, width, num, den, name).select("doc_id", "n_shingles", "component_id")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract query: components of documents whose 4-word shingle sets reach Jaccard 0.85."""
    return set_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=85, den=100)


#: The same components in SQL.  Texts of equal words are one; a set's pairs are counted by shared shingles.
SQL = """WITH RECURSIVE d AS (SELECT doc_id, array_to_string(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS k FROM documents),
w AS (SELECT k, row_number() OVER (ORDER BY k) AS t, min(doc_id) AS id, string_split(k, ' ') AS v FROM d WHERE k <> '' GROUP BY k),
s AS (SELECT DISTINCT t, unnest(list_transform(range(1, greatest(len(v) - 3, 1) + 1), lambda i: array_to_string(v[i:i + 3], ' '))) AS g FROM w),
n AS (SELECT t, count(*) AS n FROM s GROUP BY t),
o AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.t <> b.t GROUP BY a.t, b.t),
p AS (SELECT o.a, o.b FROM o JOIN n x ON x.t = o.a JOIN n y ON y.t = o.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT t AS a, t AS b FROM w UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT r.a AS t, min(w.id) AS component_id FROM r JOIN w ON w.t = r.b GROUP BY r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE c.component_id END AS component_id
FROM d LEFT JOIN w ON w.k = d.k LEFT JOIN n ON n.t = w.t LEFT JOIN c ON c.t = w.t"""
