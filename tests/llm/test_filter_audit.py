import itertools
import random

import pytest
from pyspark.sql import functions as F

from fumarole.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def words_of(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


def fails_of(rows):
    """The failed filters of every row, straight from their definitions."""
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    out = []
    for key, text, _ in rows:
        text = text or ""
        words = words_of(text)
        fails = ""
        fails += "A" * (len(words) < 50)
        fails += "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (text in least and (key is None or least[text] < key))
        out.append(fails)
    return out


def audit_by_hand(rows, labels):
    good, toxic = set(), set()
    for key, q, t in labels:
        good |= {key} if q == 1 and key is not None else set()
        toxic |= {key} if t == 1 and key is not None else set()
    fails = fails_of(rows)
    out = []
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shapley[name] += len(gone)
                failing = sum(name in f for _, f in docs)
                found.append([part, "".join(order), step, len(left), len(gone), failing - len(gone),
                              sum(f == name for _, f in docs), sum(k in good for k, _ in gone),
                              sum(k in toxic for k, _ in gone), name])
        out += [(*row[:-1], shapley[row[-1]]) for row in found]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    plain = lambda n, v: " ".join(f"w{rng.randint(0, v)}" for _ in range(n))
    texts = ["", None, "   ", "short one", plain(49, 900), plain(50, 900), plain(80, 20), plain(60, 900) + " $",
             "ABC " * 3, plain(70, 900).upper(), plain(70, 900) + " # A", "é" * 400, plain(20_000, 90_000)]
    rows = [(rng.randint(0, 400), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(300)]
    rows += rows[:20]
    rows += [(None, texts[3], "a"), (None, texts[3], "a"), (None, "only without ids", "b"), (None, "only without ids", "b")]
    rows += [(i, "the hot text", rng.choice("ab")) for i in rng.sample(range(1000), 200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 900, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_smaller_ids_retract_earlier_masks(spark, tmp_path, order):
    rows, labels = corpus()
    if order != "mixed":
        rows = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=order == "falling")
    table = spark.createDataFrame(rows, DOCS)
    for i in range(7):  # one file for each slice, so that ids arrive over several batches
        part = spark.createDataFrame(rows[i::7] if order == "mixed" else rows[i * 75 : (i + 1) * 75], table.schema)
        part.withColumns({"mask": F.lit(1), "n": F.lit(2)}).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    marks = spark.createDataFrame(labels, LABELS)
    found = fa.counters(spark, str(tmp_path / "docs"), marks, batches=4, texts_per_bucket=6)
    got = sorted(tuple(r) for r in fa.audit(found).collect())
    assert got == audit_by_hand(rows, labels)


def test_state_takes_back_what_it_counted():
    import pandas as pd

    columns = ["bucket", *fa.TEXT, *fa.ID, *fa.GROUP, "n"]
    first = pd.DataFrame([(0, 1, 1, False, 9, "a", 2, 1, 0, 1), (0, 1, 1, False, 12, "b", 2, 0, 0, 3)], columns=columns)
    state, changes = fa.retracted(first.iloc[:0].drop(columns="bucket"), first.drop(columns="bucket"))
    assert sorted(map(tuple, changes.values.tolist())) == [("a", 2, 1, 1, 0), ("b", 2 | fa.COPY, 3, 0, 0)]
    assert state["id"].tolist() == [9]
    smaller = pd.DataFrame([(0, 1, 1, False, 4, "b", 2, 0, 1, 2)], columns=columns)
    state, changes = fa.retracted(fa.unpacked(fa.packed(state)), smaller.drop(columns="bucket"))
    assert state["id"].tolist() == [4]
    assert sorted(map(tuple, changes.values.tolist())) == [
        ("a", 2, -1, -1, 0), ("a", 2 | fa.COPY, 1, 1, 0), ("b", 2, 2, 0, 2)
    ]


def test_copies_are_combined_in_a_task():
    import pandas as pd

    columns = ["bucket", *fa.TEXT, *fa.ID, *fa.GROUP, "n"]
    rows = pd.DataFrame([(0, 1, 1, False, i, "a", 0, 0, 0, 1) for i in range(500_000)], columns=columns)
    parts = list(fa.combine(iter([rows.iloc[i : i + 10_000] for i in range(0, 500_000, 10_000)])))
    assert sum(len(p) for p in parts) == 2 and sum(p["n"].sum() for p in parts) == 500_000


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "docs"))
    marks = spark.createDataFrame([], LABELS)
    assert fa.audit(fa.counters(spark, str(tmp_path / "docs"), marks)).count() == 0
