"""The command line on edge lists and text forms, and readers on lines that aren't what they should be."""

import json
import os

import pytest

from shardloom import __main__ as cli
from shardloom.functions.ids import number_within
from shardloom.operators.fixpoint import cut, shared_dir
from shardloom.sources import readers

EDGES = "# from to\nFromNode ToNode\n1 2\n2 3\n2 3\n3 3\n4 5\nx 7\n9\n"
MAP = "vid pid\n1 0\n2 0\n3 1\n4 1\n5 1\n"


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "edges.txt").write_text(EDGES)
    (tmp_path / "map.txt").write_text(MAP)
    return tmp_path


def lines(path):
    return sorted(line for name in os.listdir(path) if name.startswith("part-") for line in open(f"{path}/{name}").read().splitlines())


def test_prepare_writes_what_run_reads(spark, files, capsys):
    graph = f"{files}/graph"
    cli.main(["prepare", "--edges", f"{files}/edges.txt", "--map", f"{files}/map.txt", "--output", graph])
    # pid, vid, subgraph, then sink, its subgraph and pid; the self-loop stays an arc
    assert lines(graph) == ["0\t1 0 2 0 0", "0\t2 0 1 0 0 3 4294967296 1", "1\t3 4294967296 2 0 0 3 4294967296 1", "1\t4 4294967297 5 4294967297 1", "1\t5 4294967297 4 4294967297 1"]
    cli.main(["run", "ConnectedComponents", "--reader", "full_info", "--input", graph, "--output", f"{files}/cc", "--format", "text"])
    assert lines(f"{files}/cc") == ["1\t1", "2\t1", "3\t1", "4\t4", "5\t4"]
    cli.main(["run", "SubgraphTopology", "--reader", "full_info", "--input", graph, "--output", f"{files}/topology"])
    assert {r.sgid for r in spark.read.parquet(f"{files}/topology").collect()} == {0, 4294967296, 4294967297}
    events = [json.loads(line) for line in capsys.readouterr().err.splitlines() if line.startswith('{"event"')]
    assert {e["event"] for e in events} == {"config", "load", "run"} and all(e["seconds"] >= 0 for e in events if e["event"] == "load")


def test_run_on_an_edge_list(spark, files, capsys):
    cli.main(["run", "SSSP", "--reader", "edge_list", "--input", f"{files}/edges.txt", "--map", f"{files}/map.txt", "--output", f"{files}/out", "--format", "json", "source=1"])
    assert sorted((r.vid, r.dist) for r in spark.read.json(f"{files}/out").collect()) == [(1, 0), (2, 1), (3, 2)]
    for form in ("parquet", "neighbour_tuples", "adjacency", "json", "gml"):
        cli.main(["prepare", "--edges", f"{files}/edges.txt", "--parts", "2", "--directed", "--output", f"{files}/{form}", "--format", form])
    assert cli.load(spark, "parquet", f"{files}/parquet").edges.count() == 4
    cli.main(["list"])
    assert "KCore" in capsys.readouterr().out


@pytest.mark.parametrize("reader,text,want", [
    (readers.snap_edges, EDGES, 5),
    (readers.partition_map, MAP + "8\n9 zero\n", 5),
    (lambda s, p: readers.adjacency(s, p)[1], "head line\n1 2 x 3\n\n2\n", 2),
    (lambda s, p: readers.partitioned_adjacency(s, p)[1], "vid pid sinks\n1 0 2 y\n3\n", 1),
    (lambda s, p: readers.json_rows(s, p)[1], '[1,0,"v",[[2,7,"w"],["x",8,"w"]]]\n["id",0,"v",[]]\nnot json\n[1]\n', 1),
    (lambda s, p: readers.full_info(s, p)[1], "0\t1 10 2 20 1 3 30\npid\tvid sgid\n1\tx 3\n\n7\n", 1),
    (lambda s, p: readers.subgraph_files(s, p)[1], "5\t0\t6\t1\tx\t2\n1\t0.5\t2\ty\nhead\t1\t2\n", 1),
])
def test_readers_drop_what_is_no_number(spark, tmp_path, reader, text, want):
    (tmp_path / "lines.txt").write_text(text)
    assert reader(spark, str(tmp_path)).count() == want


def test_numbers_within_groups_follow_their_order(spark):
    rows = spark.createDataFrame([(g, (i * 7919) % 500) for g in (1, 2, None) for i in range(300 if g == 1 else 20)], "g int, x int").repartition(5)
    got = sorted((tuple(r) for r in number_within(rows, "g", ["x"], "n", cut).collect() if r.g is not None))
    want = sorted((g, x, n) for g in (1, 2) for n, x in enumerate(sorted((i * 7919) % 500 for i in range(300 if g == 1 else 20))))
    assert got == want


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

        class _jsc:
            class sc:
                class getCheckpointDir:
                    isDefined = staticmethod(lambda: False)

                getCheckpointDir = staticmethod(getCheckpointDir)

            sc = staticmethod(sc)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())
