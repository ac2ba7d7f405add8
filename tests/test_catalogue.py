import random

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from palimpsest import catalogue
from palimpsest.operators import lineage
from palimpsest.sources.store import keep


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def brute_lowest(pairs, edges):
    above = {}

    def up(x):
        if x not in above:
            above[x] = {x}.union(*(up(s) for s, d in edges if d == x))
        return above[x]

    common = {(a, b): up(a) & up(b) for a, b in pairs}
    return sorted((*p, x) for p, c in common.items() for x in c if not any(x != k and x in up(k) for k in c))


@pytest.mark.parametrize("deep", [64, 2])
def test_common_ancestors(spark, deep):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(max(0, d - 9), d), d) for d in range(1, 40) for _ in range(2)} | {(100, 101), (100, 102), (101, 103), (102, 103)})
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(7, 7), (101, 102), (103, 101), (103, 5), (500, 500), (500, 1)]
    got = lineage.common_ancestors(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(edges, "source long, dependent long"), keep, deep)
    assert sorted(tuple(r) for r in got.select("a", "b", "ancestor").collect()) == brute_lowest(set(pairs), edges)


def test_common_ancestors_keep_no_closure(spark, tmp_path, monkeypatch):
    """What is written grows with the pairs, not with all that lies above them."""
    parts, kept = 2000, []

    def spy(df):
        out = keep(df)
        kept.append(out.count())
        return out

    spark.range(parts).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(catalogue, "keep", spy)
    assert catalogue.common_ancestors(spark, str(tmp_path)).count() > parts
    assert max(kept) < 8 * parts
