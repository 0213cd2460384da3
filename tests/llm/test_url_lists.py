import datetime
import random
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from fumarole.llm import url_lists
from fumarole.llm.queries import QUERIES

DAY0 = datetime.datetime(2024, 1, 1)
ENTRY = "list string, action string, kind string, rule string, event string, at timestamp"
CAPTURE = "page_id long, url string, fetched timestamp, rule string"


def at(day):
    return None if day is None else DAY0 + datetime.timedelta(hours=day)


def parts(url):
    found = re.match(r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", url)
    return re.sub(r"\.$", "", found[1].lower()), [s for s in found[2].split("/") if s]


def brute(captures, entries):
    """(id, active entries, rule, action) by replaying every list up to the fetch time."""
    out = []
    for key, url, time in captures:
        state = {}
        if url is not None and time is not None and 0 < len(parts(url)[0]) <= 253:
            host, path = parts(url)
            events = [e for e in entries if e[3] is not None and e[5] is not None and e[5] <= time]
            for name, action, kind, rule, event, when in sorted(events, key=lambda e: (e[5], e[4])):
                h, p = parts(rule)
                if kind == "domain":
                    hit = host == h or host.endswith("." + h)
                    text = h
                else:
                    hit = host == h and path[: len(p)] == p
                    text = h + "/" + "/".join(p)
                if hit:
                    state[name, action, kind, text] = event
        active = [(k == "prefix", len(r), a == "allow", r, a) for (_, a, k, r), e in state.items() if e == "add"]
        best = max(active, default=(0, 0, 0, None, None))
        out.append((key, len(active), best[3], best[4]))
    return sorted(out, key=repr)


def test_random_lists_equal_a_replay(spark):
    rng = random.Random(12)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "xa.com", "com"]
    entries = []
    for _ in range(120):
        kind = rng.choice(["domain", "prefix"])
        rule = rng.choice(hosts) + ("" if kind == "domain" else "/" + rng.choice(["", "p", "p/q", "q/"]))
        entries.append((rng.choice("LM"), rng.choice(["allow", "block"]), kind, rule, rng.choice(["add", "remove"]), at(rng.randint(0, 4000))))
    entries += entries[:7] + [("L", "block", "domain", None, "add", at(1)), ("L", "block", "domain", "a.com", "add", None)]
    captures = []
    for i in range(400):
        url = rng.choice(["http://", "HTTPS://u@", "//", ""]) + rng.choice(hosts).upper() + rng.choice(["", ".", ":80"])
        url += rng.choice(["", "/", "/p", "/p/", "/p/q?x=/y", "//p/q#z", "/q", "/P"])
        captures.append((i, url, at(rng.randint(-50, 4100))))
    captures += captures[:5] + [(1000, None, at(9)), (1001, "http://a.com", None), (1002, "", at(3000))]
    captures += [(None, "http://a.com/" + "p/" * 5000, at(3000)), (1003, "a." * 400 + "com", at(3000))]
    table = spark.createDataFrame([(*c, "old") for c in captures], CAPTURE).repartition(3)
    found = url_lists.judge(table, spark.createDataFrame(entries, ENTRY))
    assert found.columns == ["page_id", "url", "fetched", "n_active", "rule", "action", "kept"]
    rows = found.collect()
    assert sorted(((r.page_id, r.n_active, r.rule, r.action) for r in rows), key=repr) == brute(captures, entries)
    assert all(r.kept == (r.action != "block") for r in rows)


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, "http://a.com", at(5), "")], CAPTURE)
    entries = spark.createDataFrame([("L", "block", "domain", "a.com", "add", at(1))], ENTRY)
    assert [r.kept for r in url_lists.judge(table, entries).collect()] == [False]
    assert [r.kept for r in url_lists.judge(table, entries.where(F.lit(False))).collect()] == [True]
    assert url_lists.judge(table.where(F.lit(False)), entries).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_plan_is_native(spark, sf):
    found = QUERIES["op3_url_lists"](spark, sf)
    plan = plan_of(found)
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD", "Cartesian", "NestedLoop"))
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert {r.action for r in rows} == {"allow", "block", None}
