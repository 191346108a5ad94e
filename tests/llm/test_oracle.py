import pytest
from lorequarry.llm.queries import QUERIES, SQL

from tests.oracle import DATA, check

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    check(spark, QUERIES[name], SQL[name])


def test_every_problem_is_registered():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 8)} | {"p6_ids"} <= set(QUERIES)
