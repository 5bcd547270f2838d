"""Each registered query against its SQL in DuckDB."""

import pytest

from netloom.plans import registry
from tests.compare import connect, rows

registry.load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, con, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(registry.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, sf, name):
    assert len(registry.QUERIES[name](spark, sf).toPandas())


def test_entry_without_the_text_operators():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, %r)\nimport __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys(); assert not any(k.startswith('op1') for k in e.queries())" % str(root)
    subprocess.run([sys.executable, "-c", code], check=True)
