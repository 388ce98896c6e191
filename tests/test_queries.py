import os

import pytest
from oracle import DATA, compare

from afterbell.plans import registry

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[0] == "event_type"


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert int(said.stdout) > 100, said.stderr
