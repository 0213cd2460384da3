import random

import pytest
from pyspark.sql import functions as F

from fumarole.llm import crowds, minhash


def family(rng, base, n, most):
    """Sets of n sets around a base: up to ``most`` runs of five items replaced by others."""
    found = []
    for _ in range(n):
        items = set(base)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(base))
            items -= set(base[at : at + 5])
            items |= {rng.choice([rng.getrandbits(40), at + 1000]) for _ in range(5)}
        found.append(sorted(items))
    return found


def is_near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("core", ["common", "none"])
def test_crowds_equal_all_pairs(spark, monkeypatch, core):
    rng = random.Random(11)
    one, two = list(range(100)), list(range(40)) + list(range(500, 560))
    rows = family(rng, one, 60, 6) + family(rng, two, 25, 3) + [[], [1], list(range(101))]
    if core == "none":
        monkeypatch.setattr(crowds, "cores", lambda home, sets: home.select("g").distinct().withColumn("core", F.array().cast("array<long>")))
    sets = spark.createDataFrame(list(enumerate(rows)), "c long, items array<long>")
    classes = spark.createDataFrame([(c, c % 3 + 1) for c in range(len(rows))], "c long, n long")
    crowd = {c: c % 2 if c > 80 else 0 for c in range(len(rows)) if c % 7}  # ids without a crowd ask from outside
    home = spark.createDataFrame([(c, g) for c, g in crowd.items()], "c long, g long")
    asks = [(q, g) for q in range(0, len(rows), 3) for g in (0, 1)]
    counted, pairs = crowds.crowd_counts(home, spark.createDataFrame(asks, "q long, g long"), sets, classes)
    got = dict.fromkeys({q for q, _ in asks}, 0)
    for r in counted.collect():
        got[r.q] += r.others
    listed = [tuple(r) for r in pairs.collect()]
    plain = [set(x) for x in rows]
    for q, c in listed:
        got[q] += (c % 3 + 1) * is_near(plain[q], plain[c])
    assert got == {q: sum(c % 3 + 1 for c in crowd if c != q and is_near(plain[q], plain[c])) for q in got}
    if core == "common":
        assert len(set(listed)) == len(listed) < len(got) * len(crowd) / 5


def test_near_copies_are_not_paired(spark):
    """Buckets of many near copies are not joined with themselves, and the counts stay right."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(80)] = f"n{rng.random()}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = F.col("k") % 6 == 0
    prints = minhash.edited(docs)
    by_print = {r.fingerprint: r.n_near for r in minhash.matches(docs, prints.select("k", "h", "fingerprint"), asked).collect()}
    names = {r.k: r.fingerprint for r in prints.collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(76)} for _, t in rows]
    want = {i: sum(is_near(sets[i], s) for s in sets) - 1 for i in range(0, 240, 6)}
    assert {i: by_print[names[i]] for i in want} == want

    classes = prints.withColumn("fingerprint", F.unhex("fingerprint")).select("fingerprint", asked.alias("asked"), F.col("k").alias("c"))
    pairs, home, asking = minhash.candidates(classes)
    assert home is not None and home.count() > 150
    of = {r.c: r.g for r in home.collect()}
    met = {tuple(r) for r in asking.select("q", "g").collect()}
    found = {tuple(r) for r in pairs.collect()}
    assert len(found) < 40 * 240 / 4
    assert not any((q, of.get(c)) in met for q, c in found)
