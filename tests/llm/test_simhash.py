import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from fumarole.llm import simhash
from fumarole.llm.components import components
from fumarole.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    """Smallest id reachable, for a list of (id, fingerprint)."""
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(prints):
        for j, y in prints[a + 1 :]:
            if bin(x ^ y).count("1") <= distance:
                a_root, b_root = find(i), find(j)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return {i: find(i) for i, _ in prints}


def test_fingerprints_match_plain_python():
    texts = ["", None, "one", "One two", "a b c", "A  b\tc\nd é É ñ", "x " * 5000, " \n ", "ß" * 4000]
    found = simhash.fingerprints(pa.array(texts, pa.string()))
    assert found.tolist() == [brute_fingerprint(t) for t in texts]


def test_blocks_do_not_change_fingerprints(monkeypatch):
    texts = pa.array(["the cat sat on the mat and slept", "b", "one two three four"] * 7)
    whole = simhash.fingerprints(texts)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert (simhash.fingerprints(texts) == whole).all()


def near_values(seed, n=60):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(8)] + [0, (1 << 64) - 1, 1 << 63]
    values = set(base)
    while len(values) < n:
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        values.add(x)
    return sorted(values)


def test_links_are_exactly_the_near_pairs(spark):
    for distance in (0, 1, 2, 3, 4, 5):
        values = near_values(distance)
        rows = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
        found = {(r.a, r.b) for r in simhash.links(rows, distance).collect()}
        want = {
            tuple(sorted((simhash.signed(a), simhash.signed(b))))
            for i, a in enumerate(values)
            for b in values[i + 1 :]
            if bin(a ^ b).count("1") <= distance
        }
        assert found == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)]
    links += [(7, 7), (None, 3), (5, 4), (4, 5)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 150)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d, brute_fingerprint(t)) for d, t in docs]
    want = brute_components(prints)
    rows = QUERIES["op4_simhash"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {
        (d, f"{fp:016x}", want[d]) for d, fp in prints
    }


def test_edge_rows(spark):
    rows = [
        (5, "", 1), (3, None, 2), (9, "alpha beta gamma", 3), (8, "ALPHA beta  gamma", 4),
        (8, "ALPHA beta  gamma", 4), (None, "alpha beta gamma", 5), (4, "delta", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component) for r in found) == [
        (-1, 8), (3, 3), (4, 4), (5, 3), (8, 8), (8, 8), (9, 8),
    ]
    kept = simhash.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 8, 8]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_popcount_vector_bounds_the_bit_distance(spark):
    rng = np.random.default_rng(1)
    pairs = rng.integers(-(1 << 63), 1 << 63, (200, 2)).tolist()
    rows = spark.createDataFrame(pairs, "a long, b long")
    vectors = simhash.popcounts(F.col("a")), simhash.popcounts(F.col("b"))
    for r in rows.withColumn("m", simhash.manhattan(*vectors)).collect():
        segments = [
            abs((r.a >> s & 3).bit_count() - (r.b >> s & 3).bit_count()) for s in range(0, 64, 2)
        ]
        assert r.m == sum(segments) <= ((r.a ^ r.b) & (1 << 64) - 1).bit_count()


def test_one_row_of_each_component_stays_whole(spark):
    from fumarole.llm.substrings import cut_repeats

    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcde"]
    rows = [(7, long[0], 1), (7, long[0], 2), (None, long[1], 3), (None, long[1], 4), (5, long[2], 5),
            (9, long[2], 6), (9, long[3], 7), (None, long[4], 8), (3, long[4], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(None, long[1]), (3, long[4]), (5, long[2]), (7, long[0]), (9, long[3])]
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: r[0] or -1)
    assert found == want
    left = cut_repeats(kept).select("doc_id", "kept_text").collect()
    assert sorted((tuple(r) for r in left), key=lambda r: r[0] or -1) == want
    assert simhash.one_of_each(docs.where(F.lit(False))).count() == 0
