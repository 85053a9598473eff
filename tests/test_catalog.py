import pytest

from quernstone import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(catalog.queries()[name], SQL[name])


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).agg({"count": "sum"}).first()[0] == 200


def test_no_cartesian_product_but_in_grids(spark, sf_dir):
    planned = {p.__name__ for p in catalog.plans.ALL} | set(catalog.gates.QUERIES)
    for name, query in catalog.queries().items():
        if name not in ("eval_grid", "pending_requests", "curriculum_cyclic", "keyword_relevance") and name in planned:
            plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan, name
