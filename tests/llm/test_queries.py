"""Every registered query of the subpackage against its SQL; the others have tests against brute force."""

import pytest

from harrow.llm import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert oracle.rows(got) == oracle.rows(oracle.connect(SF).execute(registry.ORACLE[name]).df())


def test_numbers():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in registry.QUERIES
