"""The contract queries that SQL can express, against their SQL on the smallest tables."""

import os
import zlib

import duckdb
import pytest

from shardloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df, relation = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    expected = sorted(relation.fetchall(), key=repr)
    assert expected and sorted((tuple(r) for r in df.select(*relation.columns).collect()), key=repr) == expected


SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def connect(tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return con


def test_mixing_sizes_and_targets_equal_sql(spark, tmp_path):
    steps = "l0 AS (SELECT sum(source_size) / sum(w) AS level FROM o)"
    for i in range(8):
        steps += f""",
l{i + 1} AS (SELECT coalesce((sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size <= w * level), 0)) / sum(w) FILTER (3 * source_size > w * level), any_value(level)) AS level FROM o, l{i})"""
    sql = f"""
WITH d AS (SELECT doc_id, source, {SIZE}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
o AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
{steps}
SELECT doc_id, size, source_size, least(3.0 * source_size, w * level) AS target FROM d JOIN o ON o.source IS NOT DISTINCT FROM d.source, l8"""
    plain = lambda rows: sorted(((a, b, c, round(x, 3)) for a, b, c, x in rows), key=repr)
    got = QUERIES["op3_mix_sources"](spark, DATA).select("doc_id", "size", "source_size", "target").collect()
    assert plain(got) == plain(connect(tmp_path).sql(sql).fetchall())


def test_language_model_counts_equal_sql(spark, tmp_path):
    con = connect(tmp_path)
    ids = [r[0] for r in con.sql("SELECT DISTINCT doc_id FROM documents").fetchall()]
    con.execute("CREATE TABLE fold (doc_id BIGINT, held_out BOOLEAN)")
    con.executemany("INSERT INTO fold VALUES (?, ?)", [(i, zlib.crc32(str(i).encode()) % 7 == 2) for i in ids if i is not None])
    sql = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(held_out, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS t FROM documents LEFT JOIN fold USING (doc_id)),
w AS (SELECT r, held_out, unnest(t) AS w FROM d),
k AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY 1),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM k)
SELECT doc_id, d.held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + 1 * (v + 1)))) AS base_score
FROM d JOIN w USING (r) LEFT JOIN k USING (w), n GROUP BY d.r, doc_id, d.held_out"""
    plain = lambda rows: sorted(((*r[:5], round(r[5], 4)) for r in rows), key=repr)
    got = QUERIES["op9_kneser_ney"](spark, DATA).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()
    assert plain(map(tuple, got)) == plain(con.sql(sql).fetchall())
