import hashlib
import re

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from test_decontamination import plain_form
from test_simhash import brute_components, brute_fingerprint
from test_substrings import brute as brute_cut

import corpus_pipeline
from fumarole.llm import byte_bpe, quality_rules

SF = "/root/testdata/sf0.001"


def cut_text(text, gone):
    """The text without some of its words and the white space behind them."""
    out, at = [], 0
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)):
        if i == 0:
            out.append(text[: m.start()])
        if i not in gone:
            out.append(m[0])
    return "".join(out)


def gone_words(docs, size=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    count = {}
    for w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            count[key] = count.get(key, 0) + 1
    return [
        {j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        for w in words
    ]


def expected(docs, items):
    measured = quality_rules.measure(pa.array([t for _, t in docs]))  # has tests of its own
    docs = [d for d, keep in zip(docs, measured["kept"].tolist()) if keep]
    classes = brute_components([(d, brute_fingerprint(t)) for d, t in docs])
    docs = [(d, t) for d, t in docs if classes[d] == d]
    gone = gone_words(docs)
    assert [len(g) for g in gone] == [row[2] for row in brute_cut(docs, 35)]
    docs = [(d, cut_text(t, g)) for (d, t), g in zip(docs, gone)]
    forms = [plain_form(t) for _, t in items]
    docs = [(d, t) for d, t in docs if not any(f in plain_form(t) for f in forms)]
    bpe = byte_bpe.ByteBpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    return {(d, tuple(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs}


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    rows = corpus_pipeline.run(spark, SF).collect()
    found = {(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in rows}
    assert found == expected([tuple(r) for r in docs], [tuple(r) for r in items])
    assert 0 < len(rows) < len(docs)


LONG = " ".join(f"word{i}" for i in range(60))
TAIL = " ".join(f"tail{i}" for i in range(90))
ODD = [
    (None, None, None, None, None),
    (None, LONG + " alpha", "en", "s", 1),
    (None, " ".join(f"other{i}" for i in range(60)), "en", "s", 2),
    (1, "", "en", "s", 0),
    (2, "a b " * 20, "en", "s", 80),
    (2, "a b " * 20, "en", "s", 80),
    (3, LONG + " alpha", "en", "s", 5),
    (4, "head " + LONG + " " + TAIL, "en", "s", 5),
]
#: Ids and texts that each stage keeps of ``ODD`` alone, from the definitions.
KEPT = {
    "quality rules": [(None, ODD[1][1]), (None, ODD[2][1]), (3, ODD[6][1]), (4, ODD[7][1])],
    "SimHash near-dedup": [(1, ""), (2, ODD[4][1]), (3, ODD[6][1]), (4, ODD[7][1]), (None, ODD[2][1])],
    "substring dedup": [
        (None, None), (None, ""), (None, ODD[2][1]), (1, ""), (2, ""), (2, ""), (3, ""), (4, "head " + TAIL),
    ],
    "benchmark decontamination": [(r[0], r[1]) for r in ODD],
}


def test_stages_keep_the_columns_and_odd_rows(spark):
    """Null ids, empty texts, repeated rows, an empty table, and columns named like results."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, table.schema)
    clash = {"kept": F.col("n_chars") * 10, "n_words": F.lit("mine"), "kept_text": F.lit(7), "t": F.lit(1), "fp": F.lit(2), "row": F.lit("r")}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, odd.withColumns(clash), table.where(F.lit(False))):
            found = stage(spark, docs, SF)
            rows = found.collect()
            if i == len(corpus_pipeline.STAGES) - 1:
                assert len(rows) == docs.count()
                continue
            assert found.columns == docs.columns and found.dtypes == docs.dtypes
            if docs.count():
                assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(KEPT[name], key=repr), name
            if docs.count() and "kept" in docs.columns:
                assert all(r.n_words == "mine" and r.kept_text == 7 and r.row == "r" for r in rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "byte-level BPE",
    ]
