import pytest

from colpack.plans.oracle import oracle_sql
from colpack.plans.queries import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_oracle(spark, sf, name):
    compare(spark, sf, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries().keys() - oracle_sql().keys()))
def test_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark).collect()
    assert found and all(r["n_docs"] == r["n_same"] for r in found)


def test_checksums_agree(spark, sf):
    assert all(r["same"] for r in queries()["checksum_crc32"](spark, sf).collect())
