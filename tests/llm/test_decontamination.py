import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fumarole.llm import decontamination as dc
from fumarole.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_form(text):
    lowered = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower())
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", lowered)).encode()


def substring_distance(pattern, text, anchored=False):
    row = [j if anchored else 0 for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            form = plain_form(item)
            if form:
                budget = dc.edit_budget(len(form))
                distance = substring_distance(form, plain_form(text))
                if distance <= budget:
                    out.add((d, i, distance, budget))
    return out


@pytest.mark.parametrize("anchored", [False, True])
def test_myers_equals_the_table_method(anchored):
    rng = random.Random(3)
    for _ in range(400):
        pattern = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 70)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        distance, end = dc.best_end(pattern, text, anchored)
        assert distance == substring_distance(pattern, text, anchored)
        assert end == 0 or substring_distance(pattern, text[:end], anchored) == distance


def edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randint(0, len(text) - 1)
        text = text[:i] + rng.choice(["", "x", text[i] + "y"]) + text[i + 1 :]
    return text


def cases():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(12)]
    items += [(20, ""), (21, None), (22, "!!!"), (23, items[3][1].upper()), (24, "abra")]
    docs = [(900, None), (901, ""), (902, "one Abra cadabra"), (903, "the abra, only")]
    for d in range(120):
        source = rng.choice(items[:12])[1]
        cut = edited(rng, source, rng.choice([0, 1, 2, 5, 9, 30]))
        around = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(2)]
        docs.append((d, f"{around[0]}\n{cut.title()}  {around[1]}"))
    return docs, items


def test_matches_brute_force_in_blocks(spark):
    docs, items = cases()
    want = brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id int, text string")
    for size in (dc.BLOCK_BYTES, 300):
        found = dc.leaks(d, i, block_bytes=size)
        assert found.columns[:2] == ["doc_id", "item_id"]
        assert {tuple(r)[:4] for r in found.collect()} == want
        assert found.count() == len(want)
    kept = dc.without_leaks(d, i, block_bytes=300)
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - {w[0] for w in want}


def test_blocks_are_held_one_at_a_time(spark, monkeypatch):
    docs, items = cases()
    rng = random.Random(4)
    items += [(100 + i, "".join(rng.choice("fghij") for _ in range(400))) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    i = spark.createDataFrame(items, "item_id int, text string").repartition(3)
    live, most, made = set(), [0], [0]
    plain = type(spark.sparkContext).broadcast

    def counted(context, value):
        held = plain(context, value)
        if isinstance(value, tuple) and isinstance(value[0], dc.Items):
            live.add(id(held))
            most[0], made[0] = max(most[0], len(live)), made[0] + 1
            end = held.destroy
            held.destroy = lambda *a: (live.discard(id(held)), end(*a))
            assert sum(len(x) for x in value[0].texts) <= 5000
        return held

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    found = {tuple(r)[:4] for r in dc.leaks(d, i, block_bytes=5000).collect()}
    assert made[0] > 5 and most[0] == 1 and not live
    monkeypatch.undo()
    assert found == {tuple(r)[:4] for r in dc.leaks(d, i).collect()}


def test_repeated_rows_leave_together_with_many_blocks(spark):
    docs = [(1, "aa bb"), (1, "aa bb"), (None, "xx the needle text yy"), (1, "the needle text"), (2, None)]
    d = spark.createDataFrame(docs, "row long, text string")
    i = spark.createDataFrame([(k, f"the needle text {'q' * k}" if k else "the needle text") for k in range(30)], "item_id int, text string")
    kept = dc.without_leaks(d, i, block_bytes=100)
    assert kept.columns == ["row", "text"]
    assert sorted(map(tuple, kept.collect())) == [(1, "aa bb"), (1, "aa bb"), (2, None)]


def test_query_matches_brute_force_on_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    exact = {(d, i) for d, t in docs for i, x in items if plain_form(x) in plain_form(t)}
    assert exact and {k for k, v in rows.items() if v == 0} == exact
    for (d, i), distance in rows.items():
        assert substring_distance(plain_form(dict(items)[i]), plain_form(dict(docs)[d])) == distance


def test_word_places_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "A b. The quick brown fox jumps over; c d", 5), (1, "A b. The quick brown fox jumps over; c d", 5)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([("q", "the quick brown fox jumps over")], "item_id string, text string")
    rows = dc.leaks(docs, items).collect()
    assert [(r.item_id, r.distance, r.first_word, r.last_word) for r in rows] == [("q", 0, 2, 7)] * 2
    none = items.where(F.lit(False))
    assert dc.leaks(docs, none).count() == 0 and dc.without_leaks(docs, none).count() == 2
    assert dc.leaks(docs.where(F.lit(False)), items).count() == 0
    assert dc.without_leaks(docs, items).columns == docs.columns


def test_a_common_piece_in_a_long_text_is_verified_once():
    block = dc.Items.of([1], ["spam " * 8 + "end of the test item"])
    text = pa.array(["spam " * 50_000])
    assert len(dc.hits_of(*dc.normal(text)[:2], block)) == 1
    assert dc.matches(text, block) == []


def test_a_tenth_of_an_item_may_be_edited(spark):
    item = "which of these seven rivers crosses most borders before it reaches the black sea?"
    near = item.replace("rivers", "shoals")
    assert len(plain_form(item)) == 80 and substring_distance(plain_form(item), plain_form(near)) in range(5, 9)
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"One, {near} and more")], "doc_id long, text string")
    assert dc.leaks(docs, items).count() == 1 and dc.without_leaks(docs, items).count() == 0


def test_matches_brute_force_with_a_budget_of_a_tenth():
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    items = [" ".join(word() for _ in range(rng.randint(1, 45))) for _ in range(25)]
    texts = []
    for source in items * 8:
        cut = edited(rng, source, rng.randint(0, len(source) // 8 + 1))
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 9))), cut, word()]))
    forms = [plain_form(x) for x in items]
    want = set()
    for t, text in enumerate(texts):
        for i, form in enumerate(forms):
            if i == t % 25 or len(form) < 20:
                distance = substring_distance(form, plain_form(text))
                if distance <= len(form) // 10:
                    want.add((t, i, distance))
    block = dc.Items.of(list(range(25)), items)
    found = {m[:3] for m in dc.matches(pa.array(texts), block)}
    assert len(want) > 100 and want <= found
    assert all(substring_distance(forms[i], plain_form(texts[t])) == d <= len(forms[i]) // 10 for t, i, d in found)
