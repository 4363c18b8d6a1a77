import pytest
from compare import compare

from logweave.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE[name], SF)
