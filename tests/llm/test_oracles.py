import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2] / "tools"))

import check_oracle  # noqa: E402

from fumarole.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = check_oracle.connect(SF)
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(df.columns) == sorted(names)
    assert all(check_oracle.same_kind(kind, kinds[c]) for c, kind in df.dtypes)
    rows = [tuple(r) for r in df.collect()]
    assert check_oracle.rows_of(df.columns, rows) == check_oracle.rows_of(names, result.fetchall())
