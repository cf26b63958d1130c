"""The driver's entry: queries against their SQL at the smallest scale, and the guard around the optional subpackage."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from shardloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUICK = ["degrees", "subgraphs_glue", "subgraph_topology", "meta_graph", "connected_components", "sssp_parents", "triangles_per_subgraph", "pagerank_fixed", "kcore", "json_roundtrip", "metis_export", "partition_labels", "subgraph_files_neighbours", "distance_export", "pagerank_dangling", "blogel_multiset_export", "meta_neighbours", "neighbour_tuples_export", "edge_ids"]


def plain(rows):
    return sorted((tuple(round(x, 7) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    df = QUERIES[name](spark, DATA)
    relation = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert plain(df.select(*relation.columns).collect()) == plain(relation.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_subpackage(tmp_path):
    code = "import sys; sys.modules['shardloom.llm'] = None\nimport __spark_entry__ as e\nassert 'pipeline' not in e.queries() and 'kcore' in e.queries()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0


def test_entry_works_without_a_library_that_only_the_subpackage_needs():
    code = "import sys, warnings; sys.modules['zstandard'] = None\nwarnings.simplefilter('ignore')\nimport __spark_entry__ as e\nassert 'op7_warc' not in e.queries() and 'kcore' in e.queries()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    if not os.path.isdir(os.path.join(root, "shardloom", "llm")):
        pytest.skip("the subpackage is not here")
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
