"""Every query of the engine runs, and equals its SQL where it has one."""

import pytest
from oracle import connect, same

from marlstone.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    if name in SQL:
        same(df, connect(sf_dir), SQL[name])
    else:
        assert df.count() >= 0


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).columns) == 4


def test_nothing_imports_llm():
    from pathlib import Path

    import marlstone

    for p in Path(marlstone.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "marlstone.llm" not in p.read_text(), p
