"""Streams of several batches with copies."""

import os
from pathlib import Path

import pytest

import compare
from merloom.plans import registry


def same(spark, d, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = registry.queries()[name](spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(compare.norm(x) for x in r) for r in df.select(*cols).collect())
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert got == sorted(tuple(compare.norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    return got


@pytest.fixture(scope="module")
def batches(data, tmp_path_factory):
    """The chunks in six files, so in two batches; the last file is a copy of the first."""
    import duckdb

    out = tmp_path_factory.mktemp("batches")
    for p in Path(data).glob("*.parquet"):
        if p.stem != "read_chunks":
            os.symlink(p, out / p.name)
    (out / "read_chunks.parquet").mkdir()
    for i in range(6):
        f = out / "read_chunks.parquet" / f"part-{i}.parquet"
        duckdb.execute(f"copy (select * from '{data}/read_chunks.parquet' where read_id % 5 = {i % 5}) to '{f}' (format parquet)")
        os.utime(f, (1e9 + 60 * i, 1e9 + 60 * i))
    return str(out)


@pytest.mark.parametrize("name", ["stream_profile", "stream_assemble_reads"])
def test_copies_in_a_later_batch_count_once(spark, batches, name):
    assert same(spark, batches, name)


def test_state_ends(spark):
    """A record that never ends goes out as it is once its time is over; one that went out is forgotten."""
    import pandas as pd

    from merloom.streaming import pipelines

    class State:
        exists, hasTimedOut, get, removed, kept = False, False, None, False, None

        def update(self, v):
            self.exists, self.get = True, v

        def setTimeoutDuration(self, ms):
            self.kept = ms

        def remove(self):
            self.removed = True

    def chunk(no, seq, last, at=1):
        return pd.DataFrame({"chunk_no": [no], "name": ["x"], "kind": [None], "seq": [seq], "finished": [last], "at": [at]})

    run = pipelines._assemble(5000)
    s = State()
    assert list(run((1, -1), iter([chunk(0, "AC\nG", False)]), s)) == [] and s.kept == 5000
    assert list(run((1, -1), iter([chunk(0, "NN", False, 0), chunk(None, "t t", False)]), s)) == []
    s.hasTimedOut = True
    (out,) = run((1, -1), iter([]), s)
    assert out.seq[0] == "ttACG" and not out.complete[0] and s.removed
    s = State()
    (out,) = run((1, 2), iter([chunk(1, "G", True), chunk(0, "A", False)]), s)
    assert out.seq[0] == "AG" and out.complete[0] and out.mate[0] == 2
    assert list(run((1, 2), iter([chunk(1, "G", True)]), s)) == []
    s.hasTimedOut = True
    assert list(run((1, 2), iter([]), s)) == [] and s.removed
