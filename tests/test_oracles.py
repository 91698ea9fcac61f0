"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import lodestream.queries as q

SF = "/root/testdata/sf0.001"
# those that take longest are run by `python tests/oracle.py`
SKIP = {"fusion_linear", "fusion_dbsf"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in q.ORACLE if n not in SKIP])
def test_twin(spark, con, name):
    n, diff = compare(spark, con, name, q.QUERIES[name], q.ORACLE[name], SF)
    assert not diff
    assert n > 0
