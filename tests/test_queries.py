import pytest
from compare import DATA, assert_same

from hyperpanel.plans import QUERIES, SQL

#: Fixed hierarchies of these queries are laid out over 500 points, and walks are costly in recursive SQL.
SLOW = {"aoi", "transition", "scale_sparsity", "landmark_weight"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["tsne_full", "bh_tsne_full", "field_tsne_full", "raster_tsne_full", "wtsne_full", "pca", "intrinsic_dim", "kmeans_full", "lsh_knn", "bipartite_session"])
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["i", "j", "w"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
