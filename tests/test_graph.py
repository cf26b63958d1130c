"""Micro-graphs with known answers."""

import numpy as np
import pyarrow as pa
import pytest

from shardloom.operators import cohesion, fixpoint, prepare, rank, stats, traversal
from shardloom.plans import bsp

PATH5 = ([(0, 1), (1, 2), (2, 3), (3, 4)], {0: 0, 1: 0, 2: 1, 3: 2, 4: 2})
STAR = ([(0, 1), (0, 2), (0, 3), (0, 4)], {0: 0, 1: 1, 2: 1, 3: 1, 4: 1})
K4 = ([(a, b) for a in range(4) for b in range(a)], {v: v for v in range(4)})
BOWTIE = ([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)], {0: 0, 1: 0, 2: 1, 3: 1, 4: 1})
ISLANDS = ([(0, 1), (2, 3)], {0: 0, 1: 0, 2: 1, 3: 1, 4: 1})


def graph(spark, shape, mode="glue", both=True, values=None):
    arcs, parts = shape
    rows = [(a, b, (values or {}).get((a, b))) for a, b in arcs]
    rows += [(b, a, (values or {}).get((b, a), v)) for a, b, v in rows] if both else []
    return prepare.build_graph(spark.createDataFrame(list(parts.items()), "vid long, pid int"), spark.createDataFrame(rows, "src long, dst long, value double"), mode)


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


def test_star_is_one_subgraph_by_glue_and_four_without(spark):
    for mode, leaves in (("glue", 1), ("local", 4)):
        g = graph(spark, STAR, mode)
        assert g.vertices.where("pid = 1").select("sgid").distinct().count() == leaves
        assert {r.sgid >> 32 for r in g.vertices.collect() if r.pid == 1} == {1}


def test_path(spark):
    g = graph(spark, PATH5)
    assert pairs(traversal.sssp(g, 0), "vid", "dist", "parent") == [(0, 0, None), (1, 1, 0), (2, 2, 1), (3, 3, 2), (4, 4, 3)]
    assert stats.meta_diameter(g).first().hops == 2
    assert {r.core for r in cohesion.kcore(g).collect()} == {1}
    assert cohesion.triangle_count(g).first().triangles == 0
    assert pairs(stats.boundary_vertices(g), "vid") == [(1,), (2,), (3,)]
    forest = traversal.spanning_forest(g)
    assert pairs(forest, "vid", "parent", "level") == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)]


def test_triangles_and_cores(spark):
    k4, bowtie = graph(spark, K4), graph(spark, BOWTIE)
    assert cohesion.triangle_count(k4).first().triangles == 4
    assert {r.core for r in cohesion.kcore(k4).collect()} == {3}
    per = pairs(cohesion.triangles_per_subgraph(k4), "sgid", "triangles")
    assert per == [(2 << 32, 1), (3 << 32, 3)]
    assert pairs(cohesion.triangle_list(bowtie), "a", "b", "c") == [(0, 1, 2), (2, 3, 4)]
    assert pairs(cohesion.triangles_per_vertex(bowtie), "vid", "triangles") == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 1)]
    assert pairs(cohesion.triangles_per_subgraph(bowtie), "sgid", "triangles") == [(0, 1), (1 << 32, 1)]
    assert cohesion.kcore_subgraph(bowtie, 2).count() == 12


def test_small_components_are_peeled_without_rounds(spark, monkeypatch):
    # a tail falls by one vertex a round; the clique has parallel arcs, an arc one way only and a loop
    arcs = [(a, a + 1) for a in range(20)] + [(a, b) for a in range(30, 35) for b in range(a, 35)] + [(30, 31), (31, 40), (50, 51)]
    g = graph(spark, (arcs, {v: v % 2 for v in {x for a in arcs for x in a} | {60}}), both=False)
    expected = pairs(cohesion.kcore(g, arcs_per_task=0), "vid", "core")
    assert dict(expected)[0] == 1 and dict(expected)[32] == 4 and dict(expected)[60] == 0
    assert pairs(cohesion.kcore(g, arcs_per_task=21), "vid", "core") == expected
    monkeypatch.setattr(cohesion, "fixpoint", None)
    assert pairs(cohesion.kcore(g), "vid", "core") == expected


def test_a_key_is_not_divided():
    keys = np.array([1, 1, 2, 2, 2, 2, 3])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[x : x + 2])], ["key"]) for x in range(0, 7, 2)]
    assert [k.tolist() for (k,) in fixpoint.whole(iter(batches), 3)] == [[1, 1, 2, 2, 2, 2], [3]]
    assert [k.tolist() for (k,) in fixpoint.whole(iter(batches), 2)] == [[1, 1], [2, 2, 2, 2], [3]]


def test_islands(spark):
    g = graph(spark, ISLANDS)
    assert pairs(stats.connected_components(g), "vid", "component") == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]
    assert pairs(traversal.sssp(g, 0), "vid") == [(0,), (1,)]
    assert traversal.spanning_forest(g).where("parent IS NULL").count() == 3
    assert pairs(traversal.assign_clusters(g, spark.createDataFrame([(0, 0), (1, 3)], "cluster int, vid long")), "vid", "cluster") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, -1)]
    clusters, size, attempts = traversal.graph_kmeans(g, 2, 0, 3)
    assert size == traversal.edge_cut(g, clusters).first().edge_cut and 1 <= attempts <= 3


def test_the_edge_cut_leaves_no_join_that_sends_all_clusters(spark):
    g = graph(spark, ISLANDS)
    cut = traversal.edge_cut(g, spark.createDataFrame([(v, v % 2) for v in range(5)], "vid long, cluster int"))
    assert "Join" not in cut._jdf.queryExecution().toString()
    assert cut.first().edge_cut == 4


def test_directed_rank_loses_weight(spark):
    g = graph(spark, ([(0, 1), (1, 2)], {0: 0, 1: 1, 2: 2}), both=False)
    got = dict(pairs(rank.pagerank(g, tol=None, max_iter=1), "vid", "rank"))
    assert got[0] == pytest.approx(0.05) and got[1] == got[2] == pytest.approx(0.85 / 3 + 0.05)
    assert sum(r.rank for r in rank.pagerank(g, tol=1e-9).collect()) < 1
    assert {r.vid for r in rank.subgraph_rank(g).collect()} == {0, 1, 2}


def test_weights_beat_hops(spark):
    g = graph(spark, ([(0, 1), (0, 2), (2, 1)], {0: 0, 1: 1, 2: 1}), values={(0, 1): 5.0, (0, 2): 1.0, (2, 1): 1.0})
    assert pairs(traversal.sssp(g, 0, weighted=True), "vid", "dist", "parent") == [(0, 0.0, None), (1, 2.0, 2), (2, 1.0, 0)]


def test_dirty_input(spark):
    arcs = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 9)], "src long, dst long")
    parts = spark.createDataFrame([(0, 0), (1, 1)], "vid long, pid int")
    assert prepare.drop_self_loops(arcs).count() == 3 and prepare.dedupe(arcs).count() == 3
    assert pairs(prepare.build_graph(parts, arcs).vertices, "vid", "pid") == [(0, 0), (1, 1), (9, 1)]
    assert prepare.build_graph(parts, arcs, on_dangling="drop").edges.count() == 3
    with pytest.raises(ValueError, match="without a vertex"):
        prepare.resolve(parts, arcs, "error")
    assert prepare.build_graph(parts, arcs).simple().edges.count() == 3
    new, table = prepare.relabel(spark.createDataFrame([(70, 5), (5, 900)], "src long, dst long"))
    assert pairs(table, "new_id", "old_id") == [(1, 5), (2, 70), (3, 900)] and pairs(new, "src", "dst") == [(1, 3), (2, 1)]


def test_partitioners(spark):
    arcs = prepare.symmetrize(spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long"))
    nodes = spark.range(21).withColumnRenamed("id", "vid")
    for method in ("hash", "modulo", "range", "labels"):
        got = prepare.assign_partitions(nodes, 3, method, arcs=arcs).collect()
        assert len(got) == 21 and {r.pid for r in got} <= {0, 1, 2}
    assert prepare.prepare(arcs, 2, mode="local").edges.count() == 40


def test_answers_do_not_depend_on_partitions(spark):
    arcs = BOWTIE[0] + [(7, 8)]
    seen = set()
    for parts in (1, 3):
        g = graph(spark, (arcs, {v: v % parts for a in arcs for v in a}))
        seen.add((tuple(pairs(stats.connected_components(g), "vid", "component")), cohesion.triangle_count(g).first().triangles, tuple(pairs(cohesion.kcore(g), "vid", "core"))))
    assert len(seen) == 1


def test_supersteps_agree_with_dataframes(spark):
    g = graph(spark, PATH5)
    counts, log, steps = bsp.run_bsp(g, bsp.CountVertices(), "sgid long, vertices long")
    assert {r.vertices for r in counts.collect()} == {5} and steps == 2
    assert log.where("metric = 'broadcast' AND superstep = 0").agg({"amount": "sum"}).first()[0] == 3
    hops, _, _ = bsp.run_bsp(g, bsp.ShortestHops(), "vid long, dist int", {"source": 0})
    assert pairs(hops, "vid", "dist") == pairs(traversal.sssp(g, 0), "vid", "dist")
    near, _, _ = bsp.run_bsp(g, bsp.SmallestSubgraph(), "sgid long, component long")
    assert pairs(near, "sgid", "component") == pairs(stats.subgraph_components(g), "sgid", "component")


def test_user_errors_fail_the_run(spark):
    class Broken(bsp.SubgraphComputation):
        def compute(self, ctx, messages):
            raise RuntimeError("user code")

    with pytest.raises(Exception, match="user code"):
        bsp.run_bsp(graph(spark, STAR), Broken(), "sgid long, value long")


def test_messages_to_all_are_combined(spark):
    class Uncombined(bsp.CountVertices):
        combine = None

    g = graph(spark, PATH5, "local")
    for program, received in ((bsp.CountVertices(), 3), (Uncombined(), 9)):
        counts, log, _ = bsp.run_bsp(g, program, "sgid long, vertices long")
        assert pairs(counts, "sgid", "vertices") == [(0, 5), (1 << 32, 5), (2 << 32, 5)]
        # one message for each subgraph, not one for each pair
        assert log.where("metric = 'received' AND superstep = 1").agg({"amount": "sum"}).first()[0] == received


def test_messages_to_vertices_that_the_sender_does_not_know(spark):
    class Far(bsp.SubgraphComputation):
        def compute(self, ctx, messages):
            if ctx.superstep == 0 and ctx.graph.pid == 0:
                ctx.send_to_vertex(4, "far")
                ctx.send_to_vertex(2, "near")
                ctx.send_to_vertex(1, "own")
            ctx.value = (ctx.value or "") + "".join(m.payload for m in messages)
            ctx.vote_to_halt()

    got, _, _ = bsp.run_bsp(graph(spark, PATH5), Far(), "sgid long, value string")
    assert pairs(got, "sgid", "value") == [(0, "own"), (1 << 32, "near"), (2 << 32, "far")]


def test_a_graph_computes_its_arcs_once_for_all_steps(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    arcs = prepare.symmetrize(spark.createDataFrame(PATH5[0], "src long, dst long")).withColumn("value", F.udf(count, "double")(F.col("src").cast("double")))
    g = prepare.build_graph(spark.createDataFrame(list(PATH5[1].items()), "vid long, pid int"), arcs)
    assert g.edges.count() == 8 and g.vertices.count() == 5
    assert seen.value <= 2 * 8  # once for dangling sinks, once for the arcs


def test_what_loops_write_broadcasts_only_small_tables(spark):
    import numpy as np

    from shardloom.operators import fixpoint

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    with fixpoint.small_broadcasts(spark):
        assert spark.conf.get(name) == str(1 << 20)
    assert spark.conf.get(name) == before


def test_diameters_equal_searches_from_all_nodes(spark, monkeypatch):
    import random

    import numpy as np

    def plain(arcs):
        most = 0
        for root in {a for a, _ in arcs}:
            dist, front = {root: 0}, [root]
            while front:
                front = list({w for v in front for u, w in arcs if u == v and w not in dist})
                most = max(most, max(dist.values()) + 1) if front else most
                dist.update(dict.fromkeys(front, max(dist.values()) + 1))
        return most

    rng = random.Random(7)
    for searches, room in ((256, 32 << 20), (2, 1)):
        monkeypatch.setattr(stats, "SEARCHES", searches)
        monkeypatch.setattr(stats, "SEARCH_BYTES", room)
        for n in (2, 9, 40, 90):
            arcs = {(v, rng.randrange(max(0, v - 4), v)) for v in range(1, n)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(n // 4)}
            arcs = {(a, b) for a, b in arcs if a != b}
            for shape in (arcs, arcs | {(b, a) for a, b in arcs}):
                via, at = (np.array(x) for x in zip(*shape, strict=True))
                assert stats.diameter(via * 10**12, at * 10**12) == plain(shape)


def test_meta_diameter_of_components_in_tasks_and_by_joins(spark):
    path = ([(v, v + 1) for v in range(6)] + [(10, 11), (11, 12)], {v: v % 3 for v in [*range(7), 10, 11, 12, 20]})
    g = graph(spark, path, "local")
    for arcs_per_task in (1 << 20, 5, 0):
        assert stats.meta_diameter(g, 2, arcs_per_task).first().hops == 6
    one = prepare.build_graph(spark.createDataFrame([(0, 0)], "vid long, pid int"), spark.createDataFrame([], "src long, dst long"))
    assert stats.meta_diameter(one).first().hops == 0


def test_components_are_contracted_in_tasks_at_any_size(spark, monkeypatch):
    import numpy as np

    from shardloom.operators import fixpoint

    rng = np.random.default_rng(5)
    near = [(i, i + 1) for i in range(400) if i % 50]  # neighbours have near ids
    far = [(int(a), int(b)) for a, b in rng.integers(0, 600, (500, 2)) * 1_000_003]
    for edges in (near + far, [(7, 7)]):
        root = {v: v for e in edges if e[0] != e[1] for v in e}
        for _ in root:
            before = dict(root)
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
            if root == before:
                break
        df = spark.createDataFrame(edges, "src long, dst long")
        for limit in (1 << 20, 256):
            monkeypatch.setattr(fixpoint, "TASK_EDGES", limit)
            assert {r["node"]: r["component"] for r in fixpoint.components(df).collect()} == root


def test_subgraphs_are_formed_only_for_what_needs_them(spark):
    from pyspark.sql import functions as F

    arcs = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 7), (5, 7)], "src long, dst long")
    rule = lambda vid: (vid % 2).cast("int")
    g = prepare.build_graph(rule, arcs)
    assert sorted(map(tuple, stats.degrees(g).collect())) == [(0, 1, 1), (1, 2, 1), (2, 1, 1), (5, 1, 0), (7, 0, 2)]
    assert cohesion.kcore(g).count() == 5 and traversal.sssp(g, 0).count() == 4
    assert "vertices" not in vars(g) and "edges" not in vars(g)
    # a sink without arcs of its own goes to its smallest source's partition, as with a table of partitions
    parts = arcs.select(F.col("src").alias("vid")).distinct().select("vid", rule(F.col("vid")).alias("pid"))
    same = prepare.build_graph(parts, arcs)
    assert sorted(map(tuple, g.vertices.collect())) == sorted(map(tuple, same.vertices.select(*g.vertices.columns).collect()))
    assert sorted(map(repr, g.edges.collect())) == sorted(map(repr, same.edges.select(*g.edges.columns).collect()))
