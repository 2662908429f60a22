import pytest

from docquarry.plans import catalog
from tests.compare import difference

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, name):
    assert name in catalog.ORACLES
    assert difference(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF) == ""
