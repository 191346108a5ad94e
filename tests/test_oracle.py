import pytest
from lorequarry.queries import QUERIES, SQL

from tests.oracle import DATA, check

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    rows = QUERIES[name](spark, str(DATA)).toPandas()
    assert len(rows)
    if name == "index_recall":
        assert rows.recall[0] >= 0.9
    if name == "entity_resolution":  # the best match of a name that is a candidate itself is no worse than the name
        assert (rows.ratio.isna() | (rows.ratio >= 0.93)).all() and rows.name.is_unique and rows.match.notna().all()
