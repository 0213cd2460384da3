import io
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fumarole.llm import token_files
from fumarole.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_codes_round_trip_and_random_access():
    rng = random.Random(6)
    for most in (200, 256, 70_000, 1 << 25):
        sizes = [rng.randint(0, 900) for _ in range(7)]
        first = np.cumsum([0, *sizes])
        ids = np.array([rng.randint(0, most) for _ in range(first[-1])], np.uint32)
        keys = [None, -5, 3, 3, 9, 1 << 40, 10]
        held = token_files.TokenFile(io.BytesIO(token_files.pack(keys, ids, first)))
        assert held.keys() == keys and held.first().tolist() == first.tolist()
        assert (held.span(0, len(ids)) == ids).all()
        for _ in range(200):
            a = rng.randint(0, len(ids) - 1)
            b = rng.randint(a, len(ids))
            assert held.token(a) == ids[a]
            assert (held.span(a, b) == ids[a:b]).all()
        with pytest.raises(IndexError):
            held.token(len(ids))


def test_reading_one_token_touches_few_bytes():
    ids = np.arange(300_000, dtype=np.uint32)

    class Counting(io.BytesIO):
        total = 0

        def read(self, size=-1):
            self.total += size
            return super().read(size)

    source = Counting(token_files.pack([1], ids, np.array([0, len(ids)])))
    held = token_files.TokenFile(source)
    source.total = 0
    assert held.token(271_828) == 271_828
    assert source.total < 300


def test_words_encode_like_whole_texts(library):
    rng = random.Random(8)
    letters = "abcDEÉñß's.,!?-019 \n\t  ́ẛ̣İΣς日本👍\x85\x1c<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", "<|endoftext|> x", "é ́e", "it's 'S don't"]
    ids, first = token_files.token_ids(pa.array([*texts, None]), PATH)
    found = [ids[a:b].tolist() for a, b in zip(first, first[1:])]
    assert found == [library(t) + [1] for t in [*texts, None]]


def expected(docs, library):
    start, out = 0, []
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*library(text), 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op6_token_files"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == expected(docs, library)


def test_many_files_and_edge_rows(spark, library, tmp_path):
    docs = [(i * 7 % 101 - 50, f"text number {i} " * (i % 9)) for i in range(101)]
    docs += [(None, "no key"), (1000, None), (1001, "")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit(0))
    folder = str(tmp_path / "tokens")
    manifest = token_files.write_token_files(rows, folder, PATH, file_tokens=50)
    names = sorted(r["name"] for r in manifest.collect())
    assert len(names) > 5 and sorted(os.listdir(folder)) == names
    found = token_files.read_token_files(folder, manifest).collect()
    key = lambda r: r[1]
    assert sorted(map(tuple, found), key=key) == expected(docs, library)
    none = token_files.write_token_files(rows.where(F.lit(False)), str(tmp_path / "none"), PATH)
    assert token_files.read_token_files(str(tmp_path / "none"), none).count() == 0


def test_control_strings_take_the_ids_of_the_plain_library_call(library):
    texts = [
        "a <|endoftext|> b", "<|startoftext|>", "x<|startoftext|>y", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> b",
        " <|endoftext|>\n\t<|startoftext|> ", "<|endof text|>", "<|endoftext|", "é<|endoftext|>漢", "a  <|endoftext|>'s",
    ]
    ids, first = token_files.token_ids(pa.array(texts), PATH)
    for text, a, b in zip(texts, first, first[1:]):
        assert ids[a : b - 1].tolist() == library(text), text
    assert library("a <|endoftext|> b") == [320, 49407, 321]
