"""Every registered query against DuckDB on the same tables."""

import numpy as np
import pytest
from conftest import DATA, rows_of

from rangeweave.operators import codec, frames, search
from rangeweave.plans import catalog, oracles


def test_every_query_has_an_oracle_or_is_approximate():
    assert set(catalog.QUERIES) - set(oracles.SQL) == {"topk_lsh", "topk_ranges_cells"}
    assert set(oracles.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(oracles.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows_of(got) == rows_of(want)


def test_topk_lsh_ranks_itself_first(spark):
    rows = catalog.QUERIES["topk_lsh"](spark, DATA).toPandas()
    first = rows[rows["rank"] == 0]
    assert len(first) == 5
    assert (first["q"] == first["vec_id"]).all()


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_correlation_bounds_cover_every_range_and_domain(spark):
    want = catalog.user_ranges(spark, DATA).select("sid", "rid").join(catalog.user_domains(spark, DATA).select("sid", "dom"), "sid")
    got = catalog.QUERIES["correlation_bounds"](spark, DATA)
    assert got.where("dom > 0").count() > 0
    assert got.count() == want.count() == got.select("sid", "rid", "dom").distinct().count()
    first = got.where("dom = 0").drop("dom").toPandas()
    assert rows_of(first) == rows_of(catalog.QUERIES["correlation_bound"](spark, DATA).toPandas())


def test_topk_lsh_fills_k_rows_and_recalls_the_exact_ones(spark):
    apart = [(j, [1.0 if i == j else 0.0 for i in range(8)]) for j in range(8)]
    e = spark.createDataFrame(apart, "e long, emb array<double>")
    got = search.topk_lsh(e.withColumnRenamed("e", "q"), e, 3, 8, query="q", entry="e").toPandas()
    assert sorted(got.groupby("q").size()) == [3] * 8
    pairs = [{(r["q"], r["vec_id"]) for r in catalog.QUERIES[n](spark, DATA).collect()} for n in ("topk_lsh", "topk_vectors")]
    assert len(pairs[0] & pairs[1]) >= 0.9 * len(pairs[1]), len(pairs[0] & pairs[1]) / len(pairs[1])


def test_cell_search_fills_k_rows_and_recalls_the_exact_ones(spark):
    got = catalog.QUERIES["topk_ranges_cells"](spark, DATA).toPandas()
    x = catalog.kinds(spark, DATA)
    exact = codec.candidates(frames.ranges(x, catalog.P.R), codec.dictionary(x, catalog.P), catalog.P)
    exact = exact.select("sid", "rid", "rank", "dom").toPandas()
    assert len(got) == len(exact)
    found, want = ({tuple(r) for r in f[["sid", "rid", "dom"]].itertuples(index=False)} for f in (got, exact))
    assert len(found & want) >= 0.9 * len(want), len(found & want) / len(want)


def test_cell_search_of_many_cells_ties_and_few_entries(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 6))
    v[100:400] = v[0]  # a hot embedding
    e = spark.createDataFrame([("long", i, x.tolist()) for i, x in enumerate(v)] + [("short", i, v[i].tolist()) for i in range(3)], "sid string, dom long, emb array<double>")
    q = e.withColumnRenamed("dom", "rid")
    names = {"on": "sid", "query": "rid", "entry": "dom"}
    exact = search.topk_blocked(q, e, 5, **names)
    every = search.topk_cells(q, e, 5, probes=900, **names)
    assert rows_of(every.toPandas()) == rows_of(exact.toPandas())
    some = search.topk_cells(q, e, 5, probes=4, **names).toPandas()
    assert sorted(set(some.groupby(["sid", "rid"]).size())) == [3, 5]
    nothing = search.topk_cells(q, e.where("dom < 0"), 5, **names)
    assert nothing.count() == 0
