"""Every core query runs, and equals its SQL on the small tables."""

import json
from pathlib import Path

import pytest

import compare
from merloom.operators import reports
from merloom.plans import registry

@pytest.fixture(scope="module")
def con(data):
    import duckdb

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, con, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(compare.norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:  # text that SQL does not write alike: its fields are those of the query that reads it back
        assert name == "report_json" and len(got) > 10
        fields = registry.queries()["report_json_rows"](spark, data)
        again = registry.queries()["report_json"](spark, data)
        assert sorted(map(str, reports.parsed_hits(again).drop("coherence").collect())) == sorted(map(str, fields.collect()))
        assert all(json.loads(x.json)["Read number"] == x.read_id for x in again.collect())
        return
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(compare.norm(r[i]) for i in at) for r in cur.fetchall())


def test_core_does_not_know_the_llm_package():
    root = Path(registry.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "merloom.llm" not in p.read_text(), p
