"""Readers and writers: example lines and round trips."""

from shardloom.operators import prepare
from shardloom.sources import readers, writers

ARCS = [(0, 1), (1, 0), (1, 2), (2, 1)]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_adjacency_takes_files_as_partitions(spark, tmp_path):
    write(tmp_path / "partition0", ["0 1", "1 0 2"])
    write(tmp_path / "partition1", ["2 1", ""])
    v, a = readers.adjacency(spark, str(tmp_path))
    assert rows(v, "vid", "pid") == [(0, 0), (1, 0), (2, 1)] and rows(a, "src", "dst") == ARCS


def test_partitioned_adjacency_and_sanitizer(spark, tmp_path):
    from pyspark.sql import functions as F

    path = write(tmp_path / "g", ["0;0;1", "1;0;0;2", "2;1;1"])
    v, a = readers.partitioned_adjacency(spark, path, lambda c: F.regexp_replace(c, ";", " "))
    assert rows(v, "vid", "pid") == [(0, 0), (1, 0), (2, 1)] and rows(a, "src", "dst") == ARCS


def test_json(spark, tmp_path):
    v, a = readers.json_rows(spark, write(tmp_path / "g", ['[1,0,"x",[[0,7,"a"],[2,8,"b"]]]', '[5,1,"",[]]']))
    assert rows(v, "vid", "pid", "value") == [(1, 0, "x"), (5, 1, "")]
    assert rows(a, "src", "dst", "eid", "value") == [(1, 0, 7, "a"), (1, 2, 8, "b")]


def test_full_info(spark, tmp_path):
    v, a = readers.full_info(spark, write(tmp_path / "g", ["0\t1 0 0 0 0 2 4294967296 1", "1\t9 4294967297"]))
    assert rows(v, "vid", "pid", "sgid") == [(1, 0, 0), (9, 1, 4294967297)]
    assert rows(a, "src", "dst", "dst_sgid", "dst_pid") == [(1, 0, 0, 0), (1, 2, 4294967296, 1)]
    v, _ = readers.full_info(spark, write(tmp_path / "h", ["1\t1 0"]), pid_base=1)
    assert rows(v, "pid") == [(0,)]


def test_subgraph_files(spark, tmp_path):
    write(tmp_path / "a", ["4\t0\t5\t1", "0\t0.5\t1", "1\t\t0\t42"])
    write(tmp_path / "b", ["5\t1", "42\t1.5"])
    v, a, near = readers.subgraph_files(spark, str(tmp_path), scale_weights=True)
    assert sorted((r.vid, r.pid, r.sgid) for r in v.collect()) == [(0, 0, 4), (1, 0, 4), (42, 1, 5)]
    assert rows(a, "src", "dst", "value") == [(0, 1, 1.0), (1, 0, 1.0), (1, 42, 43.0)]
    assert rows(near, "sgid", "neighbour_sgid", "neighbour_pid") == [(4, 5, 1)]


def test_edge_list_and_map(spark, tmp_path):
    assert rows(readers.snap_edges(spark, write(tmp_path / "e", ["# comment", "0\t1", "3 4"])), "src", "dst") == [(0, 1), (3, 4)]
    assert rows(readers.partition_map(spark, write(tmp_path / "m", ["2 1"])), "vid", "pid") == [(2, 1)]


def test_round_trips_and_exports(spark, tmp_path):
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (7, 1)], "vid long, pid int")
    g = prepare.build_graph(parts, spark.createDataFrame(ARCS, "src long, dst long"))
    for name, lines, read in (("adj", writers.adjacency_lines(g, True), readers.partitioned_adjacency), ("json", writers.json_lines(g), readers.json_rows), ("full", writers.full_info_lines(g), readers.full_info)):
        writers.write_lines(lines.select("value"), str(tmp_path / name))
        v, a = read(spark, str(tmp_path / name))
        assert rows(v, "vid", "pid") == [(0, 0), (1, 0), (2, 1), (7, 1)] and rows(a, "src", "dst") == ARCS
    writers.write_parquet(g, str(tmp_path / "parquet"))
    assert readers.parquet_graph(spark, str(tmp_path / "parquet"))[1].count() == 4
    lines, table = writers.metis_lines(spark.createDataFrame([(10, 20), (20, 30), (30, 30)], "src long, dst long"))
    assert rows(lines, "line", "value") == [(0, "3 2"), (1, "2"), (2, "1 3"), (3, "2")] and table.count() == 3
    twice = spark.createDataFrame([(1, 2), (1, 2)], "src long, dst long")
    assert writers.blogel_lines(twice).first().value == "1\t1 2" and writers.blogel_lines(twice, True).first().value == "1\t2 2"
    dist = spark.createDataFrame([(0, 0), (1, 1)], "vid long, dist int")
    assert sorted(r.value for r in writers.distance_lines(g, dist).collect()) == ["0\t0", "1\t1", "2\t32767", "7\t32767"]
    assert writers.gml_lines(g).count() == 2 + 4 + 4
    assert sorted(r.value for r in writers.vertex_value_lines(dist, " ").collect()) == ["0 0", "1 1"]


def test_subgraph_files_are_written_and_listed_by_tasks(spark, tmp_path):
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (7, 1)], "vid long, pid int")
    g = prepare.build_graph(parts, spark.createDataFrame(ARCS, "src long, dst long"))
    path = f"file://{tmp_path}/files"
    assert writers.write_subgraph_files(writers.subgraph_file_lines(g), path) == g.vertices.select("sgid").distinct().count()
    files = {p.name: p.read_text() for p in (tmp_path / "files").glob("part-*/*")}
    first = 1 << 32
    assert files["0"] == f"0\t0\t{first}\t1\n0\t0\t1\n1\t0\t0\t2\n"
    v, a, near = readers.subgraph_files(spark, path, foldered=True)
    assert rows(v, "vid", "pid") == [(0, 0), (1, 0), (2, 1), (7, 1)] and rows(a, "src", "dst") == ARCS
    assert rows(near, "sgid", "neighbour_sgid", "neighbour_pid") == [(0, first, 1), (first, 0, 0)]
