import os

import pytest

from furlong import plans
from furlong.plans import text

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["sire_specialisation", "horse_stats", "tournament_prestige", "weighted_degree", "pedigree_edges", "prior_rates", "average_ranks", "chi2", "roc_auc", "audit", "pagerank", "shortest_paths", "silhouette", "inbreeding", "kruskal", "contingency_margins", "horse_metadata", "lineage_nodes", "tripartite_nodes", "hypothesis_tests", "race_features", *text.QUERIES])
def test_query_equals_sql(spark, name):
    import duckdb
    import numpy as np

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), con.execute(plans.SQL[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all() if got[c].dtype == object else np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True), c
