import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from textlode.plans import registry

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
def test_core_queries_match_their_sql(spark):
    import duckdb

    from verify import plain

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in registry.SQL.items():
        df = registry.QUERIES[name](spark, SMALL)
        columns = sorted(df.columns)
        rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == columns, name
        order = sorted(range(len(names)), key=names.__getitem__)
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr), name


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_doesnt_need_the_subpackage():
    code = "import sys; sys.modules['textlode.llm'] = None; import __spark_entry__ as e; assert e.llm_queries is None and e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "textlode").rglob("*.py"):
        if "llm" not in path.parts:
            assert "textlode.llm" not in path.read_text(), path
