import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from fumarole.llm import byte_bpe
from fumarole.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={}
    )


def lists(bpe, texts):
    ids, first = bpe.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def test_random_texts_equal_the_library(bpe, library):
    rng = random.Random(1)
    letters = "abcdeéñ ßÜ'stlrv  \n\t.,!?019日本語👍́  \x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += ["", "'s 's''s 'll", "a  b   c \n\n d", "aaaa" * 900, " " * 5000, "<|endoftext|>"]
    assert lists(bpe, texts) == [library.encode_ordinary(t) for t in texts]


def test_code_points_of_all_classes_equal_the_library(bpe, library):
    points = [*range(0x20, 0x3000, 3), *range(0x3000, 0x33000, 97)]
    points += [p for pair in byte_bpe.UNASSIGNED for p in pair]
    texts = [f"a{chr(c)}b 1{chr(c)} !{chr(c)}'s {chr(c)}  x" for c in points if not 0xD800 <= c < 0xE000]
    assert lists(bpe, texts) == [library.encode_ordinary(t) for t in texts]


def test_small_memory_changes_nothing(bpe, library):
    small = byte_bpe.ByteBpe(bpe.ranks, public_tokenizers.PATTERN, remember=5)
    for text in ("one two three four five six seven", "one two", "eight nine one two ten eleven"):
        assert lists(small, [text]) == [library.encode_ordinary(text)]


def test_very_long_pretoken(bpe, library):
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(60_000))
    (ids,) = lists(bpe, [text])
    assert ids == library.encode_ordinary(text)
    import numpy as np

    joined, bounds = bpe.decode(np.array(ids), np.array([0, len(ids)]))
    assert joined.decode() == text and bounds.tolist() == [0, len(text)]


def test_queue_returns_lowest_rank_then_lowest_place():
    rng = random.Random(9)
    queue = byte_bpe.RankQueue(50_000)
    entries = [(rng.randint(0, 49_999), p) for p in range(300)] + [(7, p) for p in range(9, 0, -1)]
    for e in entries:
        queue.push(*e)
    assert [queue.pop() for _ in entries] == sorted(entries)
    assert not queue.top and not queue.buckets and not any(queue.words)


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for d, text in docs:
        ids = library.encode_ordinary(text)
        shas = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), text.encode())]
        want.add((d, len(ids), *shas))
    assert {tuple(r) for r in QUERIES["op7_byte_bpe"](spark, SF).collect()} == want


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (1, "", 6), (2, "hi hi", 7), (2, "hi hi", 7)], "doc_id long, text string, ids int"
    )
    found = byte_bpe.encoded(docs, PATH, public_tokenizers.PATTERN)
    assert found.columns == ["doc_id", "text", *byte_bpe.ENCODED]
    rows = sorted((r.doc_id, r.n_tokens, len(r.ids)) for r in found.collect())
    assert rows == [(1, 0, 0), (1, 0, 0), (2, 2, 2), (2, 2, 2)]
    assert byte_bpe.encoded(docs.where(F.lit(False)), PATH, public_tokenizers.PATTERN).count() == 0
