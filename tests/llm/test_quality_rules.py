import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from fumarole.llm import quality_rules as qr
from fumarole.llm import textarrays as ta


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    copies = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(copies),
        "dup_line_chars": sum(map(len, copies)),
        "n_lines": len(lines),
    }
    kept = True
    for n, share in qr.NGRAM_SHARES.items():
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}
        out[f"dup_{n}gram_chars"] = sum(len(words[j]) for j in inside)
        kept &= out[f"dup_{n}gram_chars"] <= share * max(chars, 1)
        if n == 5:
            out["n_repeat_words"] = len(inside)
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    kept &= len(copies) <= qr.LINE_SHARE * max(len(lines), 1)
    kept &= out["dup_line_chars"] <= qr.LINE_CHAR_SHARE * max(len(text), 1)
    out["kept"] = kept and not out["base_failed"]
    return out


def texts():
    rng = random.Random(3)
    out = ["", None, " \n\t\n", "one", "a\na\n\na", "é ü|ñ #\n" * 9, "x" * 10_000, "the same " * 3000]
    for _ in range(150):
        words = [rng.choice("ab é ñandú w|o#d longer-word".split()) + str(rng.randint(0, rng.choice([2, 99]))) for _ in range(rng.randint(0, 120))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words)
        out.append(text + text[: rng.randint(0, len(text))] if rng.random() < 0.5 else text)
    return out


def test_measures_equal_plain_python(monkeypatch):
    for size in (ta.BLOCK_BYTES, 50):
        monkeypatch.setattr(ta, "BLOCK_BYTES", size)
        found = qr.measure(pa.array(texts(), pa.string()))
        for i, text in enumerate(texts()):
            assert {k: v[i] for k, v in found.items()} == brute(text)


def test_rows_and_clashing_columns(spark):
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(5, "again " * 30, 7), (5, "again " * 30, 7), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    found = qr.repetition_rules(docs)
    assert found.columns == ["doc_id", "text", *qr.MEASURES]
    for r in found.collect():
        assert {k: r[k] for k in qr.MEASURES} == brute(r.text)
    assert qr.repetition_rules(docs.where(F.lit(False))).count() == 0


def passages(n, total):
    """``total`` words of one length, all different but for a passage of ``n`` that stands twice."""
    words = [f"w{i:04d}" for i in range(total - n)]
    return " ".join(words[:n] + words[n : 2 * n] + words[:n] + words[2 * n :])


def test_each_rule_rejects_texts_that_pass_the_base_rule():
    totals = {5: 60, 6: 83, 7: 104, 8: 128, 9: 157, 10: 190}
    whole = [passages(n, total) for n, total in totals.items()]
    lone = [" ".join(f"l{i}w{j}" for j in range(9)) for i in range(11)]
    short = "\n".join(x for i, line in enumerate(lone) for x in ([line, "x"] if i < 5 else [line]))
    wide = " ".join(c * 20 for c in "abcd")
    long = "\n".join([lone[0], wide, *lone[1:6], wide, *lone[6:9]])
    found = qr.measure(pa.array([*whole, short, long, passages(5, 80), lone[0]]))
    shares = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    for i, n in enumerate(totals):
        fails = [m for m, s in shares.items() if found[f"dup_{m}gram_chars"][i] > s * found["word_chars"][i]]
        assert fails == [n]
    assert found["n_dup_lines"].tolist()[6:8] == [4, 1] and not found["n_repeat_words"][6:8].any()
    assert not found["base_failed"][:9].any()
    assert found["kept"].tolist() == [False] * 8 + [True, False]
