"""Every core query runs; those with an oracle equal it."""

import pytest

from tests.compare import check
from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, duck, name):
    check(catalog.QUERIES[name](spark, data), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_catalogue_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_flagship(spark, data):
    assert catalog.flagship(spark, data).columns == ["position", "chunk_id", "source_id", "score"]


def test_partitioning_does_not_matter(spark, data):
    seen = []
    for n in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([sorted(map(repr, catalog.QUERIES[q](spark, data).collect())) for q in ("hybrid_search", "p1_found", "p2_found", "promotion_guard")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
