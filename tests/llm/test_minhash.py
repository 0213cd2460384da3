import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fumarole.llm import minhash
from fumarole.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def sets_of(text, size=5):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def neighbours_by_hand(rows, hashes):
    """(id, text, text behind) of all rows in the order of (id, hash), null ids first."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashes[i]))
    texts = [rows[i][1] or "" for i in order]
    return [(rows[i][0], t, after) for i, t, after in zip(order, texts, texts[1:] + texts[:1])]


def check(found, rows, spark):
    hashed = spark.createDataFrame([(r[1] or "",) for r in rows], "s string").select(F.xxhash64("s")).collect()
    want = []
    for key, text, after in neighbours_by_hand(rows, [h[0] for h in hashed]):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        one, two, three = (minhash.signatures(pa.array([t])) for t in (text, new, after))
        want.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), minhash.written(one)[0].hex(),
                     minhash.written(two)[0].hex(), float((one == two).mean()), float((one == three).mean())))
    names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = [tuple(r[n] for n in names) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def odd_rows():
    rng = random.Random(3)
    words = ["a", "bé", "漢字", "the", "of", "x" * 50, "🙂"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(None, "no id"), (None, "no id"), (None, None), (5, rows[5][1]), (5, "other text of five"), (90, None)]
    rows += [(91, "word " * 30_000), (92, ""), (93, "\n\t "), (94, "one")]
    return rows


def test_edited_texts_equal_a_plain_count(spark):
    rows = odd_rows()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("x")).withColumn("s", F.lit(1)).repartition(5)
    check(minhash.edited(table), rows, spark)


def test_one_row_and_none(spark):
    table = spark.createDataFrame([(1, "a b c d e f")], SCHEMA)
    check(minhash.edited(table), [(1, "a b c d e f")], spark)
    none = table.where("false")
    assert minhash.edited(none).count() == 0
    assert minhash.matches(none, minhash.edited(none), F.lit(True)).count() == 0


def test_likeness_estimates_jaccard():
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    for cut in (0, 20, 60, 150, 400):
        other = [f"z{i}" for i in range(cut)] + base[cut:]
        a, b = (minhash.signatures(pa.array([" ".join(x)])) for x in (base, other))
        true = jaccard(sets_of(" ".join(base)), sets_of(" ".join(other)))
        assert abs(minhash.likeness(a, b)[0] - true) < 0.13


def test_signatures_do_not_depend_on_the_batch():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 3, 5, 40, 900, 50_000]))) for _ in range(30)]
    together = minhash.signatures(pa.array(texts))
    alone = np.concatenate([minhash.signatures(pa.array([t])) for t in texts])
    assert (together == alone).all()


def near_by_hand(rows, asked):
    sets = [sets_of(t) for _, t in rows]
    return {
        i: sum(j != i and jaccard(sets[i], s) >= 0.8 for j, s in enumerate(sets))
        for i, (key, _) in enumerate(rows) if key is not None and asked(key)
    }


def test_matches_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for group in range(12):
        base = [f"g{group}w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(rng.choice([1, 2, 9, 40])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "a b", "a b"])]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    prints = minhash.edited(table)
    found = minhash.matches(table, prints.select("k", "h", "fingerprint"), F.col("k") % 3 == 0)
    by_print = {r.fingerprint: r.n_near for r in found.collect()}
    names = {r.k: r.fingerprint for r in prints.collect()}
    want = near_by_hand(rows, lambda k: k % 3 == 0)
    got = {i: by_print[names[rows[i][0]]] for i in want}
    assert got == want


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_minhash"](spark, SF)
    assert found.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    check(found.withColumnRenamed("doc_id", "k"), rows, spark)
    near = near_by_hand(rows, lambda k: k % 50 == 0)
    assert {r.doc_id: r.n_near for r in found.where("n_near is not null").collect()} == {rows[i][0]: n for i, n in near.items()}
    texts = dict(rows)
    assert len({(texts[r.doc_id], r.fingerprint) for r in found.collect()}) == len(set(texts.values()))
