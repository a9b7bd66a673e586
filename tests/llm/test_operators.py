"""Operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import random
import re
import textwrap
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixlode.llm import common, jaccard, langid, licenses, mixing, mpeg, packing, queries, sharding, shingles, tokencount, vectors, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def make_docs(spark, rows):
    """(doc_id, text, lang, source) rows; `size` clashes with result columns."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "x") for i, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(12000))
    return make_docs(spark, [(1, "a b c d e f", "en", "s1"), (1, "a b c d e f", "en", "s1"), (2, None, None, None), (3, "", "fr", "s2"), (None, "a b c d e f", None, "s1"), (4, long, "en", "s2"), (5, long + " end", "fr", None), (6, " \n\t ", "fr", "s1"), (None, None, None, None), (7, "!!! 123", "en", "é")])


@pytest.fixture(scope="module")
def none(spark):
    return make_docs(spark, [])


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- sharding ---------------------------------------------------------------
def check_shards(got, n, total):
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, [])) for s in range(n)]
    assert sum(counts) == total and max(counts) - min(counts) <= 1


def test_sharding(spark, odd, none, tmp_path):
    got = sharding.sharded(odd, ["doc_id"], 3, bucket_rows=2).collect()
    check_shards(got, 3, 10)
    assert sorted((str(r.doc_id), str(r.text), r.size) for r in got) == sorted((str(r.doc_id), str(r.text), r.size) for r in odd.collect())
    assert sharding.sharded(none, ["doc_id"], 3).count() == 0
    with pytest.raises(ValueError):
        sharding.sharded(odd, ["doc_id"], 0)
    sharding.write_shards(odd.where("doc_id is not null"), str(tmp_path / "out"), ["doc_id", "text"], 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_sharding_query(spark):
    got = queries.queries()["op1_sharding"](spark, SF).collect()
    check_shards(got, 8, 200)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    again = queries.queries()["op1_sharding"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(200))[0, 1]) < 0.3


def test_sharding_ignores_layout(spark):
    """Half of the rows have no id, and most of those are alike; wide rows; columns of every kind and name."""
    rows = [(i if i % 2 else None, "same" if i % 2 == 0 and i % 8 else f"t{i}" * (3000 if i % 50 == 1 else 1), {"k": i % 3}, i % 4, float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, place int, __h double").withColumnsRenamed({"m": "h"})
    df = df.withColumn("shard", F.lit("x"))
    out = [sharding.sharded(df.repartition(n), ["doc_id"], 3, seed=4, bucket_bytes=1 << 16).collect() for n in (1, 7)]
    for got in out:
        check_shards(got, 3, 2000)
    key = lambda r: (r.slot, r.shard, r.doc_id or -1, r.text, r.h["k"], r.place, r["__h"])
    assert sorted(map(key, out[0])) == sorted(map(key, out[1]))
    assert out[0][0].asDict().keys() == {"doc_id", "text", "h", "place", "__h", "shard", "slot", "law"}
    assert sorted(k[2:] for k in map(key, out[0])) == sorted((i or -1, t, h["k"], p, x) for i, t, h, p, x in rows)


# -- mixing -----------------------------------------------------------------
def test_targets():
    assert mixing.targets([("a", 10), ("b", 10), ("c", 10)], [3, 1, 2], 1.5, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.targets([("a", 100), ("b", 1)], [1, 1], 1.5, 2) == pytest.approx([149.5, 2])
    assert mixing.targets([], [], 1.5, 2) == []


def check_mix(got):
    by = {}
    for r in got:
        by.setdefault((r["target"], r["source_size"]), []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(sum(x["taken"] for x in v) - k[0]) <= 1 for k, v in by.items())


def test_mixing(spark, odd, none):
    got = mixing.mixed(mixing.with_quality(odd, None)).collect()
    check_mix(got)
    assert len(got) == 10 and mixing.mixed(mixing.with_quality(none, None)).count() == 0
    first, second = (queries.queries()["op2_mixing"](spark, SF).collect() for _ in range(2))
    check_mix(first)
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) for r in first)


def by_hand(rows, weights, cap, seed):
    """Taken words of each row: keys, order and budgets one by one."""
    size = {}
    for _, s, n, _ in rows:
        size[s] = size.get(s, 0) + n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([(s, size[s]) for s in names], [weights[i % len(weights)] for i in range(len(names))], 1.5, cap), strict=True))
    out = []
    for s in names:
        own = []
        for i, source, n, quality in rows:
            if source == s:
                u = (int(hashlib.md5(f"{seed}|{'' if i is None else i}|{n}".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
                own.append((-np.log(u) / max(quality, 1e-3), n, i))
        epochs, left = divmod(round(goal[s]), size[s]) if size[s] else (0, 0)
        for _, n, i in sorted(own, key=lambda r: r[0]):
            part = min(n, left)
            left -= part
            out.append((str(i), str(s), n, epochs * n + part))
    return sorted(out)


@pytest.mark.parametrize("quality", [0.0001, 0.5, 100.0])
def test_mixing_by_hand(spark, monkeypatch, quality):
    """Any weight, cells of any size, and many rows without id that are alike."""
    monkeypatch.setattr(mixing, "CELLS", 7)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "é", None]), rng.randrange(0, 40), quality * rng.choice([1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")
    got = mixing.mixed(df.repartition(3), cap=2.0, seed=5).collect()
    assert sorted((str(r.doc_id), str(r.source), r["size"], r.taken) for r in got) == by_hand(rows, (3, 1, 2), 2.0, 5)
    alike = rows + [(None, "a", 6, quality)] * 500
    got = mixing.mixed(spark.createDataFrame(alike, df.schema).repartition(5), seed=5).collect()
    assert sorted((str(r.doc_id), str(r.source), r["size"], r.taken) for r in got) == by_hand(alike, (3, 1, 2), 2.0, 5)


def test_quality_join(spark, monkeypatch, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (None, 1), (99, 1)], "doc_id long, quality int")
    both = []
    for most in (10, 0):
        monkeypatch.setattr(mixing, "SMALL_LABELS", most)
        both.append(sorted((str(r.doc_id), r["size"], r.quality) for r in mixing.with_quality(odd.withColumn("quality", F.lit("mine")), labels).collect()))
    assert both[0] == both[1] and ("4", 24000, 1.5) in both[0] and ("1", 6, 1.0) in both[0] and ("None", 6, 1.0) in both[0]


# -- jaccard ----------------------------------------------------------------
def brute_components(pairs_of, ids):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs_of:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def brute_jaccard(texts, ids, w, num, den):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if len(words) >= w else {tuple(words)} if words else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return sets, brute_components(pairs, ids)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(t[: rng.randrange(100, 121)]))
    return out


@pytest.mark.parametrize("block,hot", [(512, 4096), (8, 3)])
def test_jaccard_against_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT", hot)
    if hot < 10:  # components by contraction too
        monkeypatch.setattr(common, "FINISH", 9)
    texts = near_copies(1) + near_copies(2, 9) + ["The One", "the one", "the one x", None, "", "  ", "A b c d e", "a B c d e"] + near_copies(1)[:5]
    ids = [3 * i % 101 for i in range(len(texts))]
    got = jaccard.set_components(make_docs(spark, [(i, t, None, None) for i, t in zip(ids, texts, strict=True)]).repartition(3), 5, 80, 100).collect()
    sets, want = brute_jaccard(texts, ids, 5, 80, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), c) for i, s, c in zip(ids, sets, want, strict=True))


def test_jaccard_edges(spark, odd, none):
    got = sorted(rows(jaccard.set_components(odd, 4, 85, 100)), key=str)
    assert jaccard.set_components(none).count() == 0
    assert [r for r in got if r[0] == 1] == [(1, 3, 1), (1, 3, 1)] and (None, 3, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (6, 0, 6) in got and (None, 0, None) in got
    assert {r[2] for r in got if r[0] in (4, 5)} == {4}


def test_join_list_is_complete():
    rng = np.random.default_rng(0)
    for _ in range(200):
        k = int(rng.integers(2, 30))
        n = rng.integers(5, 12, k)
        pos = np.array([int(rng.integers(0, jaccard.prefix_length(int(x), 8, 10))) for x in n])
        order = np.lexsort((pos, n))
        n, pos, sid = n[order], pos[order], np.arange(k)
        want = [(i, j) for i in range(k) for j in range(i) if 10 * n[j] >= 8 * n[i] and min(n[i] - pos[i], n[j] - pos[j]) >= jaccard.needed(n[i], n[j], 8, 10)]
        assert brute_components(jaccard.join_list(n, pos, sid, 8, 10), list(range(k))) == brute_components(want, list(range(k)))


def test_linked_equals_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(150, 200)], rng.integers(0, 1 << 60, rng.integers(0, 20)).astype(np.uint64)]) for _ in range(40)]
    pairs = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert jaccard.linked(sets, 80, 100).tolist() == brute_components(pairs, list(range(40)))


def test_shingles_ignore_batching():
    texts = ["A b c d e", None, "x" * (1 << 21) + " y", "a  b\tc d e", "é à b c d"]
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts), 3)]
    assert whole == [next(iter(shingles.shingle_sets(pa.array([t], pa.string()), 3))).tolist() for t in texts]
    assert whole[0] == whole[3] and whole[1] == []


def test_percolating_clusters(spark, monkeypatch):
    """All candidates hang together by shared rare passages, but few texts link."""
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rng = random.Random(13)
    passages = [[f"p{j}x{i}" for i in range(12)] for j in range(25)]
    texts = []
    for i in range(60):
        t = [w for j in rng.sample(range(25), 5) for w in passages[j]]
        texts.append(" ".join(t))
        if i % 6 == 0:
            t[3] = f"other{i}"
            texts.append(" ".join(t))
    got = jaccard.set_components(make_docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), 4, 80, 100).collect()
    _, want = brute_jaccard(texts, list(range(len(texts))), 4, 80, 100)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and len(set(want)) < len(texts)


def passage_texts():
    """200 texts of rare passages that hang all together, no two of them near to linking, and five near copies at the end."""
    rng = random.Random(5)
    passages = [[f"p{j}x{i}" for i in range(30)] for j in range(60)]
    texts = [" ".join(w for j in rng.sample(range(60), 6) for w in passages[j]) for _ in range(200)]
    return texts + [t.replace(t.split()[7], "other") for t in texts[:5]]


@pytest.mark.parametrize("long", [2, 16])
def test_shared_passages_make_no_cluster(spark, monkeypatch, long):
    """Texts are stored and compared only where they nearly link; a cluster of all of them met itself again and again on disk."""
    tables, made = {}, jaccard.stored

    def noted(df, name):
        tables[name] = made(df, name)
        return tables[name]

    monkeypatch.setattr(jaccard, "stored", noted)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "LONG", long, raising=False)
    texts = passage_texts()
    got = jaccard.set_components(make_docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), 4, 85, 100).collect()
    _, want = brute_jaccard(texts, list(range(len(texts))), 4, 85, 100)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and want[200:] == list(range(5))
    assert tables["jaccard-texts"].count() <= 20 and "jaccard-links-3" not in tables


def test_parity_maps_lose_no_link():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(400, 700)], rng.integers(0, 1 << 63, rng.integers(0, 90)).astype(np.uint64)]) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (1, 2, 63, 64, 65, 500, 513, 600)]
    sets.sort(key=len)
    n, blobs = np.array([len(x) for x in sets]), [jaccard.parities(x) for x in sets]
    linked, close = [], []
    for j in range(len(sets)):
        for i in range(j):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                linked.append((i, j))
            # the list's sizes are cut first
            if 100 * n[i] >= 80 * n[j] and jaccard.may_link(n[i : i + 1], jaccard._maps([blobs[i]]), n[j], jaccard._maps([blobs[j]]), 80, 100).all():
                close.append((i, j))
    assert linked and set(linked) <= set(close) and len(close) < len(sets) ** 2 / 4
    met = jaccard.meet_list(n, np.zeros(len(n), np.int64), list(range(len(n))), blobs, 80, 100)
    assert brute_components(met, list(range(len(n)))) == brute_components(close, list(range(len(n))))


def test_levels_stand_out_of_a_large_corpus():
    """Cells that are all full still tell frequent shingles apart."""
    total = np.random.default_rng(0).poisson(1_000_000, 4096)
    total[:3] += [3000, 12_000, 500_000]
    levels, hot = jaccard.levels_of(total)
    assert hot[1] and hot[2] and hot.sum() == 2 and levels[2] > levels[1] > np.quantile(levels, 0.9)
    levels, hot = jaccard.levels_of(np.array([0, 0, 0, 1, 3, 4096, 5000]))
    assert hot.tolist() == [False] * 5 + [False, True] and (np.diff(levels) >= 0).all()


def test_key_filter_and_numbers(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("key"), "id")
    bits = common.key_bits(df.where("id % 10 = 0").select("key"))
    inside, outside = common.selected(df, bits), common.selected(df, bits, through=False)
    assert inside.where("id % 10 = 0").count() == 300 and outside.count() + inside.count() == 3000 and inside.count() < 400
    assert common.selected(df.union(df).coalesce(1), bits, once=["key"]).count() == inside.count()
    assert not common.passing(common.key_bits(df.limit(0).select("key")), np.arange(9)).any()
    alike = spark.createDataFrame([(None if i % 3 else i % 2,) for i in range(300)], "k int").repartition(4)
    got = common.numbered(alike, ["k"], "n").collect()
    assert {k: sorted(r.n for r in got if r.k == k) for k in (None, 0, 1)} == {None: list(range(200)), 0: list(range(50)), 1: list(range(50))}


def test_components_contract(spark, monkeypatch):
    monkeypatch.setattr(common, "FINISH", 2)
    edges = [(i, i + 1) for i in range(100, 130)] + [(1, 2), (2, 3), (7, 7)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 34 and len({got[i] for i in range(100, 131)}) == 1 and got[1] == got[3] != got[100]


# -- packing ----------------------------------------------------------------
def check_packed(got, capacity):
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_plan_is_tight():
    rng = random.Random(4)
    for _ in range(30):
        cap = rng.choice([7, 30, 100])
        counts = {rng.randrange(1, cap + 1): rng.randrange(1, 40) for _ in range(12)}
        plan = packing.Plan(counts, cap)
        at, ranks, firsts, offsets = plan.arrays()
        got = []
        for size, n in counts.items():
            for r in range(n):
                i = int(np.searchsorted(at, (size << 48) + r, side="right")) - 1
                got.append({"sequence_id": int(firsts[i] + r - ranks[i]), "offset": int(offsets[i]), "length": size})
        assert check_packed(got, cap) == plan.sequences <= max(1, -(-11 * sum(s * n for s, n in counts.items()) // (9 * cap))) * 1.4 + 1


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    parts = common.stored(packing.pieces(odd, *BPE, capacity=64, ids=True), "t")
    got = packing.packed(parts, 64).collect()
    check_packed(got, 64)
    library = Tokenizer.from_file(BPE[0])
    for key, text in ((7, "!!! 123"), (2, ""), (6, " \n\t "), (4, odd.where("doc_id = 4").first().text)):
        mine = sorted((r.piece, r.start, bytes(r.ids), r.ids_crc32, r.length) for r in got if r.doc_id == key)
        ids = b"".join(m[2] for m in mine)
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
        assert all(zlib.crc32(m[2]) == m[3] for m in mine) and all(m[4] == 64 for m in mine[1:])
    whole = packing.sequences(packing.packed(parts, 64)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in got)
    assert packing.packed(common.stored(packing.pieces(none, *BPE), "t")).count() == 0


def best_fit(lengths, capacity):
    """Sequences of plain best-fit decreasing."""
    import bisect

    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i == len(gaps):
            n += 1
            bisect.insort(gaps, capacity - x)
        else:
            gap = gaps.pop(i)
            bisect.insort(gaps, gap - x)
    return n


def test_packing_query_against_library(spark):
    from tokenizers import Tokenizer

    sf, library, want = "/root/testdata/sf0.01", Tokenizer.from_file(BPE[0]), []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want += [(r.doc_id, i, a, z - a, zlib.crc32(ids[a:z].tobytes())) for i, (a, z) in enumerate(itertools.pairwise(cuts))]
    got = queries.queries()["op4_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert check_packed(got, 2048) <= best_fit([w[3] for w in want], 2048)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(BPE[0]), packing.encoder(*BPE), random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t ", "é", "日", "'s", "12", ".", "<|endoftext|>", "\r\n", " "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(own.text(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


# -- token counts -----------------------------------------------------------
def test_token_counts(spark, odd, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.counter(path), random.Random(6)
    parts = ["a", "the", " ", "    ", "\n", "▁", "é", "日", "<s>", "</s>", "<0x0A>", "☃", "ing", "\0"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert own.text(t) == len(library.encode(t)), t
    for r in tokencount.counted(odd, path, 100).collect():
        assert r.over_limit == (r.n_tokens > 100)
    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in odd.where("doc_id is not null").collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.counted(odd.where("doc_id is not null"), path).collect()} == want
    assert tokencount.counted(none, path).count() == 0


def test_token_count_query_against_library(spark):
    import sentencepiece

    sf, library = "/root/testdata/sf0.01", sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.queries()["op5_token_counts"](spark, sf).collect()}
    assert got == {i: (len(t.encode()), n, n > 4096) for (i, t), n in zip(texts.items(), map(len, library.encode(list(texts.values()))), strict=True)}


def test_long_units_are_not_kept():
    own, enc = tokencount.counter(public_tokenizers.path("piece_bpe_32k.model")), packing.encoder(*BPE)
    word = "QUJD" * 5000
    assert own.text(word) == own.text(word + " a") - 1 and not any(len(u) > 99 for u in (*own.young, *own.old))
    assert len(enc.text("a " + word)) > 4 and not any(len(u) > 99 for u in (*enc.young, *enc.old))


# -- media ------------------------------------------------------------------
def test_media_round_trip(spark, odd, none):
    got = mpeg.features(mpeg.with_media(odd), seek=True).collect()
    assert len(got) == 10 and mpeg.features(mpeg.with_media(none)).count() == 0
    for r in got:
        assert r.payload_bytes % 576 == 0 and r.payload_bytes > 0 and len(r.frame_offsets) == r.n_frames and r.duration_samples == 1152 * r.n_frames
    by = {r.doc_id: r for r in odd.where("doc_id is not null").collect()}
    for r in (r for r in got if r.doc_id is not None):
        p = mpeg.padded(by[r.doc_id].text)
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len((by[r.doc_id].text or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert mpeg.features(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().n_bytes is None


def test_media_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.queries()["op6_media"](spark, SF).collect():
        p = mpeg.padded(texts[r.doc_id])
        data = mpeg.encode(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.duration_samples == 1152 * -(-len(p) // 1152) and len(r.frame_offsets) == r.n_frames and r.frame_offsets[-1] == r.last_frame_offset
        assert all(data[a : a + 2] == b"\xff\xfa" for a in r.frame_offsets)


def test_media_layers():
    """Layer I checksums are verified, for all modes; Layer II ones are counted as not verified; tags may follow frames."""
    for mode, covered in ((0, 32), (1, 18), (2, 32), (3, 16)):
        head = bytes([0xFF, 0xFE, 0x40, mode << 6])
        h = mpeg.header(head, 0)
        assert (h.layer, h.protected, h.covered) == (1, True, covered)
        body = bytes(range(1, covered + 1))
        frame = (head + mpeg.crc16(head[2:] + body).to_bytes(2, "big") + body).ljust(h.length, b"\0")
        s = mpeg.scan(frame * 3 + b"APETAGEX" + bytes(20))
        assert (len(s.offsets), s.protected, s.good, s.unverified) == (3, 3, 3, 0)
        bad = bytearray(frame * 3)
        bad[8] ^= 1
        assert mpeg.scan(bytes(bad)).good == 2
    head = bytes([0xFF, 0xFC, 0x80, 0xC0])
    s = mpeg.scan(head.ljust(mpeg.header(head, 0).length, b"\0") * 4)
    assert (len(s.offsets), s.protected, s.good, s.unverified) == (4, 4, 0, 4) and "crc=0/0 unverified=4" in mpeg.feature(s)


def test_media_scanner():
    payload = mpeg.padded("\xff" * 900)
    data = mpeg.encode(payload)
    clean = mpeg.scan(data)
    assert clean.payload == payload and clean.resyncs == 0 and clean.declared_frames == len(clean.offsets) and clean.tags == ["ID3v2.4", "ID3v1"] and len(clean.toc) == 100
    at = clean.offsets[0]
    dirty = mpeg.scan(data[:at] + b"\xff\xfb junk \xff" + data[at:])
    assert dirty.resyncs >= 1 and dirty.payload == payload
    broken = bytearray(data)
    broken[at + 10] ^= 1  # in the side information
    assert mpeg.scan(bytes(broken)).good == clean.good - 1
    assert mpeg.scan(b"").offsets == [] and mpeg.scan(b"\xff" * 99).offsets == []
    h = mpeg.header(b"\xff\xfb\x90\x00", 0)
    assert (h.kbps, h.rate, h.length, h.samples, h.side_info) == (128, 44100, 417, 1152, 32)
    assert mpeg.header(b"\xff\xf3\x80\xc4", 0).length == 208 and mpeg.header(b"\xff\xff\x10\x00", 0).length == 32
    assert mpeg.crc16(b"123456789") == 0xAEE7


# -- languages --------------------------------------------------------------
def test_language_codes():
    for n in (2, 3, 4, 7, 12):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n and all(abs(int(col.sum())) < n for col in c.T)


def plain_decode(model, text):
    """Language and score, trigram by trigram and bit by bit."""
    fold = lambda c: c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32
    b = [fold(c) for c in f" {text}   ".encode()]
    total = [0.0] * model.code.shape[1]
    for i in range(len(b) - 2):
        h = (b[i] * 0x9E3779B1 ^ b[i + 1] * 0x85EBCA77 ^ b[i + 2] * 0xC2B2AE3D) % 2**32
        for bit, v in enumerate(model.table[(h * 0x27D4EB2F % 2**32) >> 17].tolist()):
            total[bit] += v
    n = len(b) - 2
    loss = []
    for word in model.code.tolist():
        parts = []
        for bit, c in enumerate(word):
            margin = total[bit] / n * min(n, 256) ** 0.5 * model.slope[bit] + model.offset[bit]
            parts.append(np.log1p(np.exp(-max(-30, min(30, margin)) * c)) * model.weight[bit])
        loss.append(sum(parts))
    best = int(np.argmin(loss))
    return model.languages[best], 1 / sum(np.exp(loss[best] - x) for x in loss)


def test_language_query_against_plain_decoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, texts = langid.trained(docs), {r.doc_id: r.text for r in docs.collect()}
    for r in queries.queries()["op7_language_id"](spark, SF).collect():
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            lang, score = plain_decode(model, text)
            assert r.score == pytest.approx(score, abs=1e-3) and (r.lang_pred == lang or score < 0.51)


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, ("a" if i % 2 else "b") * 1000, "x" if i % 2 else "y", "text") for i in range(400)], "doc_id long, text string, lang string, u string")
    got = langid.training_sample(docs, 50, 10_000)
    assert {x: sum(lang == x for _, lang in got) for x in "xy"} == {"x": 10, "y": 10} and all(len(t) == 1000 for t, _ in got)
    assert 4 <= len(langid.training_sample(docs, 5)) <= 10 and len(langid.training_sample(docs, 50, 1)) == 2
    twice = docs.where("doc_id < 20").union(docs.where("doc_id < 20"))
    assert len(langid.training_sample(twice)) == len(langid.training_sample(docs.where("doc_id < 20")))


def test_languages(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.queries()["op7_language_id"](spark, "/root/testdata/sf0.01")
    both = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in both if r.held_out]
    assert len(both) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in both)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    out = langid.identified(odd, langid.fit(["hello there", "bonjour monsieur"], ["en", "fr"])).collect()
    assert {r.lang_pred for r in out if r.doc_id in (2, 3, 6, 7)} == {"und"} and all(r.score == 0 and not r.ambiguous for r in out if r.lang_pred == "und")
    assert {r.lang_pred for r in langid.identified(odd, None).collect()} == {"und"} and langid.trained(none) is None
    assert langid.identified(none, langid.fit(["a"], ["en"])).count() == 0
    assert {r.lang_pred for r in langid.identified(odd.where("doc_id = 1"), langid.fit(["a"], ["en"])).collect()} == {"en"}
    many = [chr(97 + i) for i in range(9)]
    model = langid.fit([f"{c * 3} {c * 5} {c * 4}" for c in many], many)
    assert [many[i] for i in model.decode(model.evidence(pa.array([f"{c * 4} {c * 3}" for c in many])))[0]] == many


# -- archives ---------------------------------------------------------------
@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    caps = [warc.Capture("http://x/", "1.2.3.4", "20010203040506", warc.http_block(i, p)) for i, p in enumerate([b"", b"\n\nhttp://y/ 1 2 3 4\n", b"x" * 300])]
    caps += [warc.Capture("dns:x", "1.2.3.4", "20010203040506", b"20010203040506\nx. 100 IN A 1.2.3.4\n\r\n\r\n.", "text/dns"), warc.Capture("http://z/", "1.2.3.4", "20010203040506", b"HTTP/1.0 204 No Content\r\nA: b"), caps[0]]
    data = warc.arc_file("f.arc", version, caps)
    assert list(warc.parse_arc(data)) == caps
    info, *records = warc.parse_warc(warc.convert(data, [None, None, warc.Original(0, "http://x/", "20010203040506"), None, None, None], "f.warc"))
    assert info.kind == "warcinfo" and info.headers["WARC-Filename"] == "f.warc" and f"description: {version} 0 Archive".encode() in info.block
    assert [r.kind for r in records] == ["response", "response", "revisit", "resource", "response", "response"] and records[0].headers["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert records[2].headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"x" * 300).hexdigest() and records[2].headers["WARC-Refers-To-Target-URI"] == "http://x/"
    assert records[3].block == caps[3].block and records[3].headers["Content-Type"] == "text/dns" and records[4].block == caps[4].block
    assert records[4].headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"").hexdigest()
    assert len({r.headers["WARC-Record-ID"] for r in (info, *records)}) == 7
    for broken in (data[:-100], data.replace(b"HTTP/1.0 204", b"HTTP/1.0 205") if version == 2 else data[:-100], data.replace(b"http://x/ ", b"http://xx/ ", 1) if version == 2 else data[:-100]):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))


def test_payloads_are_measured(spark):
    block = warc.http_block(5, b"y" * 200)
    good = warc.warc_record(warc.Capture("u", "0.0.0.0", "20010203040506", block), "<urn:a>")
    bad = good.replace(hashlib.sha256(b"y" * 200).hexdigest().encode(), hashlib.sha256(b"z").hexdigest().encode())
    assert warc.records(spark.createDataFrame([(bytearray(good),)], "warc binary")).first().payload_bytes == 200
    with pytest.raises(Exception, match="does not match its digest"):
        warc.records(spark.createDataFrame([(bytearray(bad),)], "warc binary")).collect()


def test_warc(spark):
    big = "é" * 60
    pages = spark.createDataFrame([(5, "http://a b", big), (3, None, big), (9, "u", big), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (None, "u", big), (8, "u", "z" * 100), (8, "u", "z" * 100)], "page_id long, url string, html string")
    got = sorted(rows(warc.read_archives(common.stored(warc.archives(pages), "t")).select("page_id", "payload_bytes", "record_type", "refers_to")), key=str)
    want = [(5, 120, "revisit", 3), (3, 120, "response", None), (9, 120, "revisit", 3), (4, 5, "response", None), (6, 5, "response", None), (7, 0, "response", None), (None, 120, "revisit", 3), (8, 100, "response", None), (8, 100, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.read_archives(common.stored(warc.archives(pages.limit(0)), "t")).count() == 0
    ids = [r.record_id for r in warc.read_archives(common.stored(warc.archives(pages), "t")).collect()]
    assert len(ids) == len(set(ids)) == 9
    long = spark.createDataFrame([(1, "u", "é" * 3_000_000, "x"), (2, "u", "é" * 3_000_000, "y"), (3, "v", "short", "z")], "page_id long, url string, html string, d string").withColumn("key", F.lit(1)).withColumn("refers_to", F.lit(7))
    got = sorted(rows(warc.read_archives(common.stored(warc.archives(long), "t")).select("page_id", "payload_bytes", "record_type", "refers_to")))
    assert got == [(1, 6_000_000, "response", None), (2, 6_000_000, "revisit", 1), (3, 5, "response", None)]


# -- vectors ----------------------------------------------------------------
@pytest.mark.parametrize("block", [None, 40])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "LEAF", 16)
    if block:  # components by contraction too
        monkeypatch.setattr(common, "FINISH", 9)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    x = np.vstack([base[rng.integers(0, 12, 150)] + rng.normal(scale=0.25, size=(150, 6)), rng.normal(size=(60, 6))])
    x = np.vstack([x, x[:7]])
    data = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 0.9, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    ids = [d[0] for d in data]
    comp = brute_components([(i, j) for i in range(len(x)) for j in range(i) if hit[i, j]], ids)
    assert got == {ids[i]: (int(hit[i].sum()) - 1, comp[i], ids[i] == comp[i]) for i in range(len(x))}


def test_dense_vectors(spark):
    """20,000 vectors that nearly all link: bounded time, whole counts."""
    import time

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=8) + rng.normal(scale=0.02, size=(19_990, 8)), rng.normal(size=(10, 8))]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    began = time.time()
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, 0.9).collect()}
    assert time.time() - began < 60
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for i in (0, 7, 19_989, *range(19_990, 20_000)):
        assert got[i][0] == int((u @ u[i] >= 0.9).sum()) - 1
    assert {got[i][1] for i in range(19_990)} == {0}


def test_near_blocks_in_tiles(spark):
    """Tiles of boxes give the pairs that all boxes together give."""
    rng = np.random.default_rng(9)
    low = rng.uniform(-1, 1, (30, vectors.AXES + 1))
    high = low + rng.uniform(0, 0.4, low.shape)
    dims = [2 + i % 2 for i in range(30)] + [3]
    low, high, block = np.vstack([low, low[:1]]), np.vstack([high, high[:1]]), [*range(30), 0]
    boxes = spark.createDataFrame([(b, d, x.tolist(), y.tolist()) for b, d, x, y in zip(block, dims, low, high, strict=True)], "block int, dim int, low array<double>, high array<double>")
    want = {(b, b) for b in block}
    for i in range(31):
        for j in range(31):
            gap = np.maximum(0, np.maximum(low[i] - high[j], low[j] - high[i]))
            if dims[i] == dims[j] and (gap**2).sum() <= 1.2**2:
                want.add((block[i], block[j]))
    for tile in (7, 100):
        got = rows(vectors.near_blocks(boxes, 30, 1.2, tile))
        assert len(got) == len(set(got)) and set(got) == want
    assert 40 < len(want) < 900


def test_leaf_components_agree(monkeypatch):
    """The two ways to unite a leaf's hits, by pairs and by spreading, are one."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    axes = np.eye(4)[:, :2]
    out = []
    for few in (0, 10**9):
        monkeypatch.setattr(vectors, "FEW", few)
        left, right = (vectors._Interval(np.arange(a, z), np.ones(z - a, np.int64), x[a:z], axes) for a, z in ((0, 50), (50, 90)))
        for pair in ((left, None), (left, right)):
            nodes, counts, roots = vectors._Join(*pair, 0.8, np.sqrt(0.4)).result()
            parts = {}
            for n, r in zip(nodes, roots, strict=True):
                parts.setdefault(r, []).append(n)
            out.append((nodes, counts, sorted(map(sorted, parts.values()))))
    assert out[:2] == out[2:] and len(out[0][0]) > 10


def test_vector_edges(spark):
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [-0.0, 1e-200]), (10, [0.0, 1e200])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted(rows(vectors.near_vectors(df)), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)] + [(None, 1, 10, False), (10, 1, 10, True)]
    assert got == sorted(want, key=str)
    assert vectors.near_vectors(df.limit(0)).count() == 0


# -- licences ---------------------------------------------------------------
def test_licenses(spark, none):
    mit = licenses.LICENCES["MIT"][1]
    texts = ["MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit.split("\n\n", 1)[1].replace("sublicense", "sub-license"), mit.upper(), "x " + mit, None, "", "Copyright me\n(c) you", "This work is licenced under the GNU General Public Licence, version 3", mit]
    got = {r.doc_id: (r.license_id, r.digest) for r in licenses.scanned(make_docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT", None, None, None, None, "GPL-3.0", "MIT"]
    assert got[3][1] is None and got[4][1] == got[5][1] == hashlib.sha256(b"").hexdigest()
    assert licenses.scanned(none).count() == 0


def test_license_ties(spark):
    """Two licences of one canonical text: the first by name; repeated rows alike."""
    docs = make_docs(spark, [(1, "same TEXT", None, None), (1, "same TEXT", None, None), (None, "Same, text", None, None)]).withColumn("digest", F.lit("x")).withColumn("license_id", F.lit("y"))
    got = licenses.scanned(docs, {"B": ["Same text"], "A": ["same  text!"]}, {"C": [hashlib.sha256(b"same text").hexdigest()]}).collect()
    assert [r.license_id for r in got] == ["A"] * 3 and {r.digest for r in got} == {hashlib.sha256(b"same text").hexdigest()}


def test_clashing_columns(spark, odd):
    """Columns named like results, or like what operators make within, don't matter."""
    names = ["lang_pred", "score", "ambiguous", "u", "piece", "start", "length", "ids", "__r", "g", "p", "media", "feature", "n_bytes", "n_tokens", "text_key", "key", "sid", "n", "cells", "target", "taken", "__s", "quality"]
    docs = odd.select("*", *[F.lit("mine").alias(c) for c in names])
    model, path = langid.fit(["hello there", "bonjour monsieur"], ["en", "fr"]), public_tokenizers.path("piece_bpe_32k.model")
    same = [
        lambda d: langid.identified(d, model).select("doc_id", "lang_pred", "score", "ambiguous"), lambda d: tokencount.counted(d, path), lambda d: packing.pieces(d, *BPE, capacity=64),
        lambda d: mpeg.features(mpeg.with_media(d)), lambda d: jaccard.set_components(d, 4, 85, 100), lambda d: mixing.mixed(mixing.with_quality(d, None)),
    ]
    for f in same:
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(odd).collect()))
    carried = langid.identified(docs, model)
    assert carried.columns[-3:] == ["lang_pred", "score", "ambiguous"] and {r.sid for r in carried.collect()} == {"mine"}


def rewrapped(text, width, lead=""):
    """The paragraphs of a text at a width; lines that are notices stay as they are."""
    out = []
    for part in re.split(r"\n\s*\n", text):
        lines = [" ".join(x.split()) for x in part.strip("\n").split("\n")]
        for notice, group in itertools.groupby(lines, lambda x: bool(re.match(r"copyright \W|copyright \d", x, re.I))):
            out += list(group) if notice else textwrap.wrap(" ".join(group), width, break_long_words=False, break_on_hyphens=False)
        out.append("")
    return "\n".join(lead + x for x in out)


def test_wrapped_licenses(spark):
    isc = """ISC License

Copyright (c) 2020, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""" + licenses._ISC_END
    cases = [("ISC", isc)] + [(k, rewrapped(t, w, lead)) for k, forms in licenses.LICENCES.items() for t in forms for w in (*range(9, 100), 120, 200) for lead in ("", " * ")]
    cases += [("BSD-3-Clause", rewrapped(licenses.LICENCES["BSD-3-Clause"][0].replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), w, "# ")) for w in range(9, 100)]
    got = {r.doc_id: r.license_id for r in licenses.scanned(make_docs(spark, [(i, t, None, None) for i, (_, t) in enumerate(cases)])).collect()}
    assert [(k, t) for i, (k, t) in enumerate(cases) if got[i] != k] == []


def test_full_licenses(spark):
    files = {"Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    assert set(files) == set(licenses.DIGESTS)
    cases, end = [], "END OF TERMS AND CONDITIONS"
    for name, file in files.items():
        text = Path("/usr/share/common-licenses", file).read_text()
        for form in (text, *([text.split(end)[0] + end] if end in text else [])):
            widths = () if name == "MPL-1.1" else (*range(40, 100), 120, 200)  # its Exhibit A has a notice to fill in within a sentence
            cases += [(name, form), *((name, rewrapped(form, w)) for w in widths)]
        cases.append((None, text + " Besides, more holds."))
    got = {r.doc_id: r.license_id for r in licenses.scanned(make_docs(spark, [(i, t, None, None) for i, (_, t) in enumerate(cases)])).collect()}
    assert [(k, t) for i, (k, t) in enumerate(cases) if got[i] != k] == []


def test_copyright_notices(spark):
    notices = ["Copyright (c) 2020 Someone", "Copyright © 2020 Someone", "copyright 1999-2020, Some One Inc.", "Copyright: 2020 me", "Copyright, 2020, me", "Copyright [yyyy] [name of copyright owner]", "Copyright <YEAR> <COPYRIGHT HOLDER>", "Copyright(C) me", "Copyright The Some Authors", "Copyright by me", "# Copyright Élan", "(c) 2020 me", "(C) Copyright me", "(c) Some One", "(c) Some One, Inc. or its affiliates", "Copyright Will Someone", "(c) May Someone", "Copyright AT&T", " * © me", "All rights reserved.", "Copyright 37 Things\r"]
    bodies = ["copyright notice and this", "copyright holders be liable", "COPYRIGHT HOLDER OR", "copyright owner or by", "copyright", "copyrighted works", "copyright, patent, trademark", "copyright license to reproduce", "copyright and related rights", "(c) You must retain, in the Source form", "(c) under Patent Claims infringed by", "copyright law.", "copyright will not apply"]
    docs = make_docs(spark, [(i, f"a\n{t}\nb", None, None) for i, t in enumerate(notices + bodies)])
    got = {r.doc_id: r.c for r in docs.select("doc_id", licenses.canonical(F.col("text")).alias("c")).collect()}
    assert [t for i, t in enumerate(notices + bodies) if (got[i] == "a b") != (i < len(notices))] == []


def test_license_query_finds_texts(spark, tmp_path):
    """The query over documents of which many are licences, against its SQL."""
    import duckdb

    cases = [(name, t) for name, forms in licenses.LICENCES.items() for form in forms for t in (form, form.upper(), f"Copyright (c) 2021 Some One\n\n{form}", form + " And more.", form.replace("license", "licence"), form * 2)]
    cases += [(None, t) for t in ("", None, "word " * 200_000, "Copyright (c) 2020 me", cases[0][1][:-20])] + cases[:2]
    docs = make_docs(spark, [(i, t, "en", "s") for i, (_, t) in enumerate(cases)])
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = licenses.op10_licenses(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, digest, license_id FROM ({licenses.sql()})").fetchall()
    assert sorted(rows(got.select("doc_id", "digest", "license_id"))) == sorted(want)
    found = {r.doc_id: r.license_id for r in got.collect()}
    hits = {n for n in found.values() if n}
    assert hits == set(licenses.LICENCES) and sum(found[i] == name for i, (name, _) in enumerate(cases) if name) >= 3 * len(hits)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_sql_on_odd_rows(spark, odd):
    import duckdb

    con = duckdb.connect()
    plain = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "source")
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in plain.collect()], pa.schema({"doc_id": pa.int64(), "text": pa.string(), "source": pa.string()})))
    con.register("labels", pa.table({"doc_id": [1, 1, 4, 99], "quality": [1, 0, 1, 1]}))
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (99, 1)], "doc_id long, quality int")
    mix = mixing.mixed(mixing.with_quality(plain, labels), seed=2).select("doc_id", "size", "source_size", "target", "taken")
    for got, sql in ((mix, mixing.SQL), (jaccard.set_components(plain, 4, 85, 100), jaccard.SQL)):
        assert sorted(rows(got)) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall())
