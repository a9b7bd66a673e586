"""The pipeline's stages on their own inputs."""

import collections
import hashlib
import os
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from mixlode.llm import common, jaccard, langid, mixing
from tests.llm.test_operators import best_fit, brute_jaccard, check_packed, make_docs, near_copies, passage_texts, plain_decode

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    spoken = pipeline.language(spark, docs, SF)
    assert spoken.columns == docs.columns and spoken.count() >= 0.98 * len(before)
    unique = pipeline.near_duplicates(spark, spoken, SF)
    left = sorted(r.doc_id for r in spoken.select("doc_id").collect())
    _, components = brute_jaccard([before[i].text for i in left], left, 5, 80, 100)
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(set(components))
    mixed = pipeline.mix(spark, unique, SF)
    assert mixed.columns == docs.columns and mixed.count() > 0
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 2
    check_packed(pipeline.pack(spark, mixed, SF).collect(), 2048)


def test_near_duplicates_with_shared_passages(spark, monkeypatch):
    """A corpus whose texts share passages is not one cluster whose texts meet on disk."""
    names, made = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: (names.append(name), made(df, name))[1])
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    docs = make_docs(spark, [(i, t, "en", "s") for i, t in enumerate(passage_texts())])
    kept = pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    assert "pipeline-jaccard-texts" in names and "pipeline-jaccard-links-3" not in names


def test_language_stage_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.trained(docs)
    sure = {r.doc_id: plain_decode(model, r.text)[1] for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    kept = {r.doc_id for r in pipeline.language(spark, docs, SF).collect()}
    assert {i for i, s in sure.items() if s > langid.AMBIGUOUS + 1e-3} <= kept <= {i for i, s in sure.items() if s > langid.AMBIGUOUS - 1e-3}


def taken_whole(docs, labels):
    """How often each row of (doc_id, source, words) is in the mix, one by one."""
    size = collections.Counter()
    for _, s, n in docs:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([(s, size[s]) for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5, 2.0)
    out = collections.Counter()
    for s, target in zip(names, goal, strict=True):
        epochs, left = divmod(round(target), size[s]) if size[s] else (0, 0)
        own = []
        for i, source, n in docs:
            if source == s:
                u = (int(hashlib.md5(f"2|{'' if i is None else i}|{n}".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
                own.append((-np.log(u) / labels.get(i, 1.0), n, i))
        for _, n, i in sorted(own, key=lambda r: r[0]):
            reach = max(0, min(n, left))
            left -= n
            out[i] += epochs + (reach > 0 and 2 * reach >= n) if n else 0
    return {i: n for i, n in out.items() if n}


def test_mixing_stage_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        marks[r.doc_id].append(r.quality)
    labels = {i: float(np.mean([q for q in v if q is not None]) + 0.5) for i, v in marks.items()}
    rows = [(r.doc_id, r.source, len(mixing_words(r.text))) for r in docs.collect()]
    got = collections.Counter(r.doc_id for r in pipeline.mix(spark, docs, SF).collect())
    assert dict(got) == taken_whole(rows, labels)


def mixing_words(text):
    import re

    return re.findall(mixing.WORD, text or "")


def test_few_documents_are_shuffled(spark, monkeypatch):
    """Labels beyond a broadcast, and copies, do not make the stages shuffle whole documents; filters that let all through change no result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)).unionByName(docs.where("doc_id < 5")).repartition(4, "doc_id")
    rows = lambda df: sorted((r.doc_id, r.text or "", r.source) for r in df.collect())
    all_rows = docs.collect()
    _, components = brute_jaccard([r.text for r in all_rows], [r.doc_id for r in all_rows], 5, 80, 100)
    kept, mixed = pipeline.near_duplicates(spark, docs, SF), rows(pipeline.mix(spark, docs, SF))
    assert {r.doc_id for r in kept.where("text <> ''").collect()} <= set(components) and max(i for i, _, _ in rows(kept)) < 1_000_000
    entered, made = [], mixing.with_quality
    monkeypatch.setattr(mixing, "SMALL_LABELS", 0)
    with monkeypatch.context() as m:
        m.setattr(mixing, "with_quality", lambda df, labels: (entered.append(df.count() if "r" in df.columns else 0), made(df, labels))[1])
        assert rows(pipeline.mix(spark, docs, SF)) == mixed
    assert max(entered) < 0.2 * len(all_rows)
    unsure, made_told = [], pipeline.told
    with monkeypatch.context() as m:
        m.setattr(pipeline, "told", lambda df, filters, sure=True: (unsure.append(0 if sure or "r" not in df.columns else made_told(df, filters, False).count()), made_told(df, filters, sure))[1])
        assert rows(pipeline.near_duplicates(spark, docs, SF)) == rows(kept)
    assert max(unsure) < 0.2 * len(all_rows)
    monkeypatch.setattr(common, "PART_BITS", 4)
    monkeypatch.setattr(common, "FILTER_BITS", 4)
    assert rows(pipeline.near_duplicates(spark, docs, SF)) == rows(kept) and rows(pipeline.mix(spark, docs, SF)) == mixed


def test_shuffle_files_go_with_their_query(spark):
    """What a stored table was made of is off the disk before the next is made, and the session's setting is as before."""
    switch = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(switch)
    blocks = lambda: sum(len([f for f in names if f.startswith("shuffle_")]) for _, _, names in os.walk(root))
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getParent()
    left = blocks()
    for i in range(3):
        common.stored(spark.range(1000).repartition(7, "id"), f"cleanup-{i}")
    for _ in range(50):
        if blocks() <= left:
            break
        time.sleep(0.2)
    assert blocks() <= left and spark.conf.get(switch) == before


def test_clashing_columns(spark):
    """Columns named like those that the stages make within are carried as they are."""
    names = ["r", "key", "text_key", "first", "times", "size", "quality", "part", "lang_pred", "score", "ambiguous", "d", "n", "col"]
    a = "hello there friend of mine today and every day"
    docs = make_docs(spark, [(i, f"{a} {i // 2}" if i % 2 else f"{a} {i // 2} and so on and on for {i} more", "en", "s") for i in range(40)])
    docs = docs.drop("size").select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in pipeline.STAGES[:3]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        some = got.collect()
        assert some and all(r[c] == f"{c}-{r.doc_id}" for r in some for c in names), name
    assert pipeline.STAGES[3][1](spark, docs, SF).count() == 40


def test_long_and_null_rows(spark):
    long = " ".join(f"word{i % 5003} tail{i % 17}" for i in range(30_000))
    rows = [(None, None, None, None)] * 30 + [(None, "the same text again and again here", "en", None)] * 300 + [(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "", None, "b")]
    docs = make_docs(spark, rows).repartition(4)
    assert sorted(str(r.doc_id) for r in pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(["None"] * 30 + ["None", "1", "3"])
    mixed = pipeline.mix(spark, docs, SF)
    same = mixed.where("text like 'the same%'").count()
    assert mixed.where("text is null or text = ''").count() == 0 and 300 <= same <= 600
    got = pipeline.pack(spark, docs, SF).collect()
    assert len([r for r in got if r.doc_id is None]) == 330 and check_packed(got, 2048) <= best_fit([r.length for r in got], 2048)
    model = langid.fit(["the same text", "un autre"], ["en", "fr"])
    assert langid.identified(docs, model).where("lang_pred = 'und'").count() == 31


def test_odd_rows(spark):
    rows = [(1, "hello there friend of mine today", "en", "a"), (1, "hello there friend of mine today", "en", "a"), (2, None, None, None), (3, "", "fr", None), (4, "bonjour monsieur le président de la", "fr", "b"), (None, "hello there friend of mine now", None, "a")]
    docs = make_docs(spark, rows)
    for _, stage in pipeline.STAGES:
        stage(spark, docs, SF).count()
        stage(spark, docs.limit(0), SF).count()
    kept = pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "None"]
    group = make_docs(spark, [(i, t, "en", "a") for i, t in enumerate(near_copies(9, 12) + near_copies(9, 3))])
    _, components = brute_jaccard([r.text for r in group.orderBy("doc_id").collect()], list(range(15)), 5, 80, 100)
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, group, SF).collect()) == sorted(set(components))


def test_rows_without_own_id(spark):
    a, b, c = "one two three four five six", "the other text has seven words here", "and a third one that stands alone"
    docs = make_docs(spark, [(1, a, "en", "s"), (None, a, "en", "s"), (None, b, "en", "s"), (None, b, "fr", "s"), (2, c, "en", "s"), (2, a, "en", "s"), (2, None, None, "s"), (2, None, None, "s")])
    kept = pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (None, b), (2, c), (2, None), (2, None)], key=str)
    lot = make_docs(spark, [(5, a, "en", "s")] * 3 + [(i, b, "en", "s") for i in range(6, 12)])
    counts = {r.doc_id: r["count"] for r in pipeline.mix(spark, lot, SF).groupBy("doc_id").count().collect()}
    assert counts[5] in (3, 6) and all(n in (1, 2) for i, n in counts.items() if i != 5)


def test_run(spark):
    got = pipeline.run(spark, SF).collect()
    assert check_packed(got, 2048) <= best_fit([r.length for r in got], 2048)
