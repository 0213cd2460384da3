import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from fumarole.llm import substrings
from fumarole.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(docs, size):
    """(id, words, removed, digest) of every (id, text), from the definition."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in docs]
    seen = collections.Counter(
        tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1)
    )
    out = []
    for (key, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_random_texts_with_planted_repeats(spark):
    rng = random.Random(5)
    for size, gram in ((6, 2), (9, 4), (35, 8)):
        letters = "ab" if size < 9 else "abcdé"
        shared = [[rng.choice(letters) for _ in range(rng.randint(1, 3 * size))] for _ in range(6)]
        docs = []
        for i in range(60):
            w = []
            for _ in range(rng.randint(0, 5)):
                w += [f"{rng.choice(letters)}{rng.randint(0, 40)}" for _ in range(rng.randint(0, size))]
                piece = rng.choice(shared)
                a = rng.randint(0, len(piece))
                w += piece[a : rng.randint(a, len(piece))]
                if rng.random() < 0.2:
                    w += [rng.choice(letters)] * rng.randint(1, 3 * size)
            docs.append((i, rng.choice([" ", "\n", "\t  "]).join(w)))
        docs += docs[:5] + [(None, docs[7][1]), (None, None), (3, "other text of an id used twice")]
        rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        found = substrings.cut_repeats(rows, size=size, gram=gram)
        got = found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert order(got) == order(brute(docs, size))


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op5_substrings"](spark, SF).collect()
    assert order(rows) == order(brute([tuple(r) for r in docs], 35))
    assert sum(r.n_removed for r in rows) > 0


def test_text_keeps_its_white_space_and_columns(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"  head\n{passage}\n\ntail ", "x", 7), (2, passage, "y", 8), (3, None, "z", 9), (4, "", "", 1)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, t string, n_removed int")
    found = substrings.cut_repeats(rows, size=10, gram=3)
    assert found.columns == ["doc_id", "text", "t", *substrings.CUT]
    got = {r.doc_id: (r.kept_text, r.n_removed, r.t) for r in found.collect()}
    assert got == {1: ("  head\ntail ", 12, "x"), 2: ("", 12, "y"), 3: ("", 0, "z"), 4: ("", 0, "")}
    assert substrings.cut_repeats(rows.where(F.lit(False))).count() == 0


def test_one_long_text_repeats_itself(spark):
    rng = random.Random(2)
    part = [f"w{rng.randint(0, 10**6)}" for _ in range(40_000)]
    docs = [(1, " ".join(part + ["middle"] + part)), (2, "a " * 30_000)]
    found = substrings.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in found.collect()} == {
        1: (80_001, 80_000),
        2: (30_000, 30_000),
    }


def test_texts_of_one_tag_without_ids_are_kept_apart(spark):
    """Two texts whose 32-bit hashes agree share all words but the last."""
    shared = " ".join(f"w{i}" for i in range(40))
    tried = spark.range(400_000).select(F.concat(F.lit(shared + " x"), F.col("id").cast("string")).alias("s"))
    pair = tried.groupBy(F.hash("s")).agg(F.collect_list("s").alias("s")).where("size(s) > 1").first()["s"][:2]
    rows = spark.createDataFrame([(None, pair[0]), (None, pair[1])], "doc_id long, text string")
    found = substrings.cut_repeats(rows).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == order(brute([(None, t) for t in pair], 35))
    assert {r.kept_text for r in found} == {t.split()[-1] for t in pair}


def test_many_copies_of_one_text_list_its_spans_once(spark):
    draw = random.Random(8)
    text = " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(100))
    docs = [(None, text)] * 10_000 + [(1, text + " more"), (2, "head " + text[:300])]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    tagged = rows.select(F.col("doc_id").alias("k"), *substrings.tags(F.col("text")), F.col("text").alias("s"))
    spans = {r["k"]: r["spans"] for r in substrings.repeat_spans(tagged).collect()}
    assert len(spans) == 3 and max(map(len, spans.values())) <= 100
    got = substrings.cut_repeats(rows).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert (None, 100, 100, 10_000) in [tuple(r) for r in got] and (1, 101, 100, 1) in [tuple(r) for r in got]
