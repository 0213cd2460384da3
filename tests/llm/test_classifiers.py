import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fumarole.llm import quality_classifier as qc
from fumarole.llm import toxicity as tx
from fumarole.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held_out(key, parts, rest):
    return zlib.crc32(str(key).encode()) % parts == rest


@pytest.mark.parametrize(
    "name,label,parts,rest,cut",
    [("op8_quality_classifier", "quality", 4, 2, 0.7), ("op10_toxicity", "toxic", 5, 0, 0.5)],
)
def test_held_out_accuracy(spark, name, label, parts, rest, cut):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == held_out(r.doc_id, parts, rest)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    common = max(sum(labels[r.doc_id] == k for r in held) for k in (0, 1))
    assert right > common and right >= 0.9 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for score, label, parts, rest in ((qc.quality_scores, "quality", 4, 2), (tx.toxicity_scores, "toxic", 5, 0)):
        flip = F.when(qc.remainder(F.col("doc_id"), parts) == rest, 1 - F.col(label)).otherwise(F.col(label))
        found = [
            {r.doc_id: round(r.score, 9) for r in score(docs, table).collect()}
            for table in (labels, labels.withColumn(label, flip))
        ]
        assert found[0] == found[1]


def test_class_sums_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = (rng.random(200) < 0.3).astype(int)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "y int, x array<double>")
    sums = qc.class_sums(rows.repartition(3))
    for k in (0, 1):
        assert sums[k][0] == (y == k).sum()
        assert np.allclose(sums[k][1], x[y == k].sum(axis=0))
        assert np.allclose(sums[k][2], x[y == k].T @ x[y == k])


def test_scores_equal_gaussian_densities():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (100, 3))])
    y = np.repeat([0, 1], [300, 100])
    sums = {k: (float((y == k).sum()), x[y == k].sum(axis=0), x[y == k].T @ x[y == k]) for k in (0, 1)}
    model = qc.Discriminant.fit(sums, pooling=0.3, ridge=0.1)
    spread = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (300 * spread[0] + 100 * spread[1]) / 400
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for k in (0, 1):
        cov = 0.9 * (0.7 * spread[k] + 0.3 * pooled) / np.outer(scale, scale) + 0.1 * np.eye(3)
        d = (x - x[y == k].mean(axis=0)) / scale
        part = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        logs.append(part - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == k).mean()))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(2)
    net = tx.Network.begin(rng.normal(size=1 << tx.BITS).astype(np.float32))
    texts = [rng.integers(0, 1 << tx.BITS, (n, 3)).astype(np.int32) for n in (0, 1, 2, 9, 40)]
    buckets, first = tx.joined(texts)
    best, place, _ = net.pooled(buckets, first)
    assert np.allclose(best, net.maxima(buckets, first), atol=1e-5)
    for t, text in enumerate(texts):
        words = net.embed[text].sum(axis=1)
        for w, width in enumerate(tx.WIDTHS):
            for f in range(tx.FILTERS):
                outs = [
                    sum(words[i + o] @ net.filters[w][o, :, f] for o in range(width) if i + o < len(words))
                    for i in range(len(words))
                ]
                column = w * tx.FILTERS + f
                assert np.isclose(best[t, column], max([0, *outs]), atol=1e-4)
                if best[t, column] > 0:
                    assert np.isclose(outs[place[t, column] - first[t]], max(outs), atol=1e-4)


def test_inflected_words_share_their_stem():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    vocabulary = [word() for _ in range(60)]
    talk = lambda extra: " ".join([*rng.choice(vocabulary, 30), *extra])
    data = [(talk([f"vextor{word()}"] if i % 3 == 0 else []), int(i % 3 == 0)) for i in range(300)]
    buckets, first = tx.word_buckets(pa.array([t for t, _ in data]))
    texts = [buckets[a:b] for a, b in zip(first, first[1:])]
    y = np.array([k for _, k in data])
    net = tx.fit(texts[:200], y[:200], (100, 50))
    found = net.scores(*tx.joined(texts[200:])) >= 0.5
    assert (found == y[200:]).mean() > 0.97


def test_cuts_have_the_best_f1_of_each_language(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(3000):
        lang = ["en", "de", None][k % 3]
        y = int(rng.random() < 0.3)
        rows.append((k, lang, float(np.clip(rng.normal(0.35 + 0.2 * y + 0.05 * (k % 3), 0.15), 0, 1)), y))
    rows += [(9000 + k, "one", 0.4, 0) for k in range(5)]
    scored = spark.createDataFrame([r[:3] for r in rows], "k long, lang string, score double")
    unseen = spark.createDataFrame([(r[0], r[3]) for r in rows], "k long, y int")
    totals = {0: 4 * sum(r[3] == 0 for r in rows), 1: sum(r[3] for r in rows)}
    weights = tx.threshold_counts(scored, unseen, totals)
    got = {r["lang"]: r["cut"] for r in tx.best_cuts(weights, ["lang"], 0.5).collect()}
    assert set(got) == {"en", "de", None}
    for lang, cut in got.items():
        own = [(s, y) for _, name, s, y in rows if name == lang]

        def f1(c):
            hit = sum(y for s, y in own if s >= c)
            return 2 * hit / (hit + 4 * sum(1 - y for s, y in own if s >= c) + sum(y for _, y in own))

        assert f1(cut) == pytest.approx(max(f1(b / tx.BUCKETS) for b in range(tx.BUCKETS)))


def test_all_unseen_training_rows_count_and_a_repeated_key_is_learnt_once(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} text") for k in range(60)] + [(1, "zz")] * 500, "doc_id long, text string")
    chosen = spark.createDataFrame([(k, k % 2) for k in range(30)], "k long, y int")
    texts, labels = tx.sample_texts(docs, chosen, "text", "doc_id")
    assert len(texts) == 30 and labels.tolist() == [0] * 15 + [1] * 15
    scored = spark.createDataFrame([(k, "en", 0.5) for k in range(60)], "k long, lang string, score double")
    unseen = spark.createDataFrame([(k, k % 2) for k in range(30, 60)], "k long, y int")
    row = tx.threshold_counts(scored, unseen, {0: 30, 1: 45}).first()
    assert (row.b, row.w0, row.w1) == (500, 30.0, 45.0)


def test_words_of_a_class_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tx, "CLASS_WORDS", 100)
    docs = spark.createDataFrame([(k, "a b c d e f g h i j") for k in range(60)], "doc_id long, text string")
    chosen = spark.createDataFrame([(k, int(k < 5)) for k in range(60)], "k long, y int")
    _, labels = tx.sample_texts(docs, chosen, "text", "doc_id")
    assert np.bincount(labels).tolist() == [10, 5]


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", 0.5), (2, "", None, 0.5), (None, "x", "en", 0.5), (3, "a b", "de", 0.1), (3, "a b", "de", 0.1)],
        "doc_id long, text string, lang string, score double",
    )
    labels = spark.createDataFrame(
        [(1, None, None), (3, 1, 1), (3, 0, 0), (9, 5, 5)], "doc_id long, quality int, toxic int"
    )
    for score in (qc.quality_scores, tx.toxicity_scores):
        for table, level in ((labels.where(F.lit(False)), 0.5), (labels, None)):
            rows = score(docs, table).collect()
            assert len(rows) == 5 and len({r.score for r in rows}) == 1
            assert level is None or rows[0].score == level
        assert score(docs.where(F.lit(False)), labels).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert qc.quality_scores(docs, labels).first().score == 0.5
    assert tx.toxicity_scores(docs, labels).first().score == 0.5
