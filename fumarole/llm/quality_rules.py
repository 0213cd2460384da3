"""Quality rules by repetition coverage.

Rolling hashes of n-grams of 5 to 10 words find the n-grams that a text holds twice or more;
the share of the text's characters that lie inside them, and inside repeated lines, decides.
The work is one narrow pass: no shuffle, a few bytes of state per byte of the current texts.

Defined cases: a null text counts as empty and fails the base rule (fewer than ten words); a
repeated row is judged like any other; an empty table gives an empty result; columns of the
input named like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fumarole.llm import textarrays as ta

#: Highest share of a text's word characters inside repeated n-grams, by n-gram length. The
#: first occurrence counts too. All are tighter than the base rule's share of words in 5-grams.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Highest share of lines equal to an earlier line, and of characters on such lines.
LINE_SHARE = 0.20
LINE_CHAR_SHARE = 0.10
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "dup_line_chars": "long",
    "n_lines": "long",
    **{f"dup_{n}gram_chars": "long" for n in NGRAM_SHARES},
}


def line_counts(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and the latter's code points."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    if len(lines) == len(set(lines)):
        return len(lines), 0, 0
    seen, copies, chars = set(), 0, 0
    for line in lines:
        if line in seen:
            copies += 1
            chars += len(line.decode("utf-8", "replace"))
        seen.add(line)
    return len(lines), copies, chars


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a run of texts."""
    data, bounds = ta.flat(texts)
    words = ta.words_of(data, bounds)
    first = words.first
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[words.end] - points[words.start]
    hashes = ta.hash_spans(data, words.start, words.end)
    sequence = ta.Sequence(hashes)
    owner = ta.mix(words.doc.astype(np.uint64) + np.uint64(1))

    out = {
        "n_words": words.counts,
        "word_chars": ta.per_text(chars, first),
        "n_symbols": ta.per_text(SYMBOLS[data], bounds),
    }
    # an n-gram can only repeat where its leading (n - 1)-gram repeats
    starts = ta.window_starts(first, min(NGRAM_SHARES))
    for n in NGRAM_SHARES:
        starts = starts[starts + n <= first[1:][words.doc[starts]]]
        starts = starts[ta.repeated(sequence.span(starts, starts + n) ^ owner[starts])]
        inside = ta.covered(len(words), starts, starts + n)
        if n == 5:
            out["n_repeat_words"] = ta.per_text(inside, first)
        out[f"dup_{n}gram_chars"] = ta.per_text(np.where(inside, chars, 0), first)

    raw = data.tobytes()
    lines = [line_counts(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    table = np.array(lines, np.int64).reshape(-1, 3)
    out |= {"n_lines": table[:, 0], "n_dup_lines": table[:, 1], "dup_line_chars": table[:, 2]}

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]
    )
    total = np.maximum(out["word_chars"], 1)
    kept = ~out["base_failed"]
    for n, share in NGRAM_SHARES.items():
        kept &= out[f"dup_{n}gram_chars"] <= share * total
    kept &= out["n_dup_lines"] <= LINE_SHARE * np.maximum(out["n_lines"], 1)
    all_chars = np.maximum(points[bounds[1:]] - points[bounds[:-1]], 1)
    kept &= out["dup_line_chars"] <= LINE_CHAR_SHARE * all_chars
    out["kept"] = kept
    return out


def repetition_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and the verdict of every text added."""
    added = [c for c in docs.columns if c not in MEASURES or c == text]
    kept = docs.select(*added)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, text):
                values = measure(part.column(text))
                columns = [pa.array(values[name]) for name in MEASURES]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *columns], names=[*part.schema.names, *MEASURES]
                )

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
        + [f"{name} {kind}" for name, kind in MEASURES.items()]
    )
    return kept.mapInArrow(judge, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition_rules(docs).drop("text")
