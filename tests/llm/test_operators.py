"""Every operator against a brute-force version on small fixtures with nulls, empty texts, repeats, ties and clashing columns."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import _text
from shardloom.llm.balltree import exact_top_k, integer_vectors
from shardloom.llm.compactwindows import compact_windows, passage_dedup, without_repeats
from shardloom.llm.decontaminate import decontaminate, tile
from shardloom.llm.mixing import mix_sources, mixed_documents, pivot
from shardloom.llm.ngramjoin import ngram_components, one_of_each
from shardloom.llm.ngramlm import kneser_ney_scores
from shardloom.llm.quality import fit_quality, score_quality
from shardloom.llm.suffixdedup import repeated_windows, substring_dedup, suffix_array
from shardloom.llm.toxicity import fit_ordinal, fit_toxicity, score_toxicity
from shardloom.llm.warc import decode_record, encode_record, read_warc, warc_round_trip, with_revisits, write_warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, source string, bucket long, c1 string, n int"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh éß") for _ in range(rng.randint(2, 6))).replace(" ", "x") for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 160)) for _ in range(40)]
    texts = list(base)
    for t in base[:10]:  # near copies at several distances
        for edits in (1, 2, 5):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            texts.append(" ".join(w))
    shared = prose(rng, 70)
    texts += [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(4)]
    texts += [base[0], base[0], base[1].upper(), "", None, " \n\t", "two words", "TWO words", "a" * 700, "to " * 120, prose(rng, 3000)]
    rows = [(i, t, ["s1", "s2", None][i % 3] if i % 2 else "s1") for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "s2"), (None, texts[4], "s2"), (None, "lonely null id", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in corpus()], DOC).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")


def test_words_and_shingles_match_regex():
    texts = ["Abc  dEf\tÉx\n", "", None, "x" * 600_000 + " y", "a\x0bb\x1cc", "z"]
    data, offsets = _text.buffer(pa.array(texts))
    starts, ends, h, rows = _text.words(data, offsets)
    got = [[bytes(data[a:b]).decode().translate(LOWER) for a, b in zip(starts[p:q], ends[p:q])] for p, q in zip(rows[:-1], rows[1:])]
    assert got == [words_of(t) for t in texts]
    flat = [w for row in got for w in row]
    assert len(set(h.tolist())) == len(set(flat))
    token, first = _text.shingles(h, rows, 3)
    assert np.diff(first).tolist() == [max(1, len(g) - 2) if g else 0 for g in got]


def test_mixing_meets_targets(docs, empty):
    rows = mix_sources(docs, bucket=8, fan=4).collect()
    size = lambda t: len(WORD.findall(t or ""))
    want = collections.Counter()
    for _, t, s in corpus():
        want[s] += size(t)
    order = sorted(want, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(want.values()) - sum(3 * want[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3.0 * want[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * want[s]}
        if not over:
            break
        capped |= over
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((i, size(t)) for i, t, _ in corpus())
    for s in order:
        own = [r for r in rows if r.source == s]
        assert own[0].source_size == want[s] and own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in own)
    again = mix_sources(docs.repartition(2), bucket=8, fan=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.k1, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixed_documents(docs, bucket=8, fan=4).count() == sum(r.copies for r in rows)
    assert mix_sources(empty).count() == 0


def test_pivot_keeps_expectations():
    rng = np.random.default_rng(0)
    x, size = np.array([0.2, 0.5, 0.9, 0.4]), np.array([3.0, 5.0, 2.0, 8.0])
    runs = np.array([pivot(x, size, rng.random(4), True) for _ in range(4000)])
    assert set(runs.ravel()) == {0.0, 1.0} and np.abs(runs.mean(0) - x).max() < 0.04


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_ngram_join_finds_every_component(docs, n, num, den):
    rows = corpus()
    sets = []
    for _, t, _ in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    want = collections.Counter((k, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (k, _, _) in enumerate(rows))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs, n, num, den).collect())
    assert got == want
    assert any(len(v) > 2 for v in least.values())
    kept = one_of_each(docs, n, num, den)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


def test_ngram_join_of_nothing(empty):
    assert ngram_components(empty).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 60, 400):
        for a in (1, 2, 200):
            t = rng.integers(0, a, n).astype(np.uint8)
            raw = t.tobytes()
            assert suffix_array(t, 1 << 20).tolist() == sorted(range(n), key=lambda i: raw[i:])
    again = repeated_windows([b"abcdefgh", b"xxabcdefyy"], np.array([False, False]), 6)
    assert again.tolist() == [True, False, False, False, False, True, False, False]


@pytest.mark.parametrize("length,gram", [(200, 64), (40, 16)])
def test_suffix_dedup_matches_brute_force(docs, empty, length, gram):
    rows = [(i, (t or "").encode()) for i, t, _ in corpus()]
    count = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    want = collections.Counter()
    for k, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(b) else 0
        want[(k, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    assert collections.Counter(map(tuple, substring_dedup(docs, length, gram).collect())) == want
    assert substring_dedup(empty).count() == 0


def test_compact_windows_are_cartesian_tree_nodes():
    rng = np.random.default_rng(1)
    rows = np.array([0, 7, 7, 9, 40])
    v = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for least in (1, 3, 5):
        want = []
        for q in range(4):
            x = v[rows[q] : rows[q + 1]].tolist()
            for c in range(len(x)):
                lo = max([i + 1 for i in range(c) if x[i] < x[c]], default=0)
                hi = min([i - 1 for i in range(c + 1, len(x)) if x[i] < x[c]], default=len(x) - 1)
                want += [(q, lo, c, hi)] if hi - lo + 1 >= least else []
        assert sorted(zip(*[x.tolist() for x in compact_windows(v, rows, least)])) == sorted(want)


def test_passages_are_cut_from_later_texts(docs, empty):
    rows = corpus()
    got = collections.defaultdict(list)
    for r in passage_dedup(docs).collect():
        got[r.doc_id].append(r)
    seen = {}
    for k, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(t)
        hits = [i for i in range(len(w) - 49) if seen.get(tuple(w[i : i + 50]), k) != k]
        if hits and len(set(w)) > 5:
            assert got[k][0].n_removed >= 50, k
        if not any(tuple(w[i : i + 25]) in seen for i in range(len(w))):
            assert all(r.n_removed == 0 for r in got[k]), k
        for n in (25, 50):
            for i in range(len(w) - n + 1):
                seen.setdefault(tuple(w[i : i + n]), k)
    assert sum(map(len, got.values())) == len(rows) and all(r.n_removed == 0 for r in got[None])
    clean = without_repeats(docs, length_col="n")
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert passage_dedup(empty).count() == 0


def test_decontamination_finds_reordered_passages(spark, docs, empty):
    rng = random.Random(9)
    items = [prose(rng, 40) for _ in range(6)]
    half = items[1].split()
    mixed = prose(rng, 30) + " " + " ".join(half[20:]) + " " + prose(rng, 9) + " " + " ".join(half[:20]) + " " + prose(rng, 30)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, items[0]), (None, None), (7, "")], "item_id long, text string")
    extra = spark.createDataFrame([(900, prose(rng, 10) + " " + items[0].translate({b: a for a, b in LOWER.items()}) + "!"), (901, mixed), (902, " ".join(items[2].split()[:10]))], "doc_id long, text string")
    out = {r.doc_id: r for r in decontaminate(docs.select("doc_id", "text").unionByName(extra), bench).collect()}
    assert (out[900].coverage, out[900].item_id, out[901].item_id) == (1.0, 0, 1)
    assert out[902].coverage < 0.5 and out[902].item_id is None
    assert sum(r.item_id is not None for r in out.values()) == 2
    assert tile([1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3], 3) == 6 and tile([1, 2, 3, 4], [1, 2, 9, 3, 4], 3) == 0
    assert decontaminate(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).where("coverage > 0").count() == 0


def test_warc_round_trip(spark, tmp_path):
    big, rows = "é" * 300, []
    for i in range(60):
        rows.append((i, f"http://x/{i}\n", big if i in (5, 9, 30) else None if i == 7 else "" if i == 8 else "short" if i < 3 else f"<p>{i}</p>" * 40))
    rows += [(5, "http://again", big), (None, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = collections.Counter(map(tuple, warc_round_trip(pages).collect()))
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == big and i != 5
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)] += 1
    assert got == want
    folder = f"file://{tmp_path}/w"
    manifest = write_warc(with_revisits(pages), folder, roll=4000)
    assert manifest.count() > 2
    assert {r.payload for r in read_warc(spark, folder).where("page_id = 20").collect()} == {b"<p>20</p>" * 40}
    written = next(tmp_path.glob("w/*.warc.zst")).read_bytes()
    assert written[:4] == (0x184D2A5D).to_bytes(4, "little")  # the file itself begins with the dictionary's frame
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_warc_refuses_damage():
    good = encode_record(1, b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None, False)
    r = decode_record(good)
    assert (r.page_id, r.payload_bytes, r.payload_digest, r.record_type) == (1, 3, hashlib.sha256(b"abc").hexdigest(), "response")
    for bad in (good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            decode_record(bad)


def foreign(kind, block, record_id, *more, eol="\r\n"):
    lines = ["WARC/1.0", f"warc-type:{kind}", f"WARC-RECORD-ID: {record_id}", "Warc-Date:   2020-02-02T00:00:00Z", *more, f"content-length:{len(block)}"]
    return eol.join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_reads_archives_of_other_writers(spark, tmp_path):
    import base64
    import struct

    import zstandard

    body = b"<p>hello</p>"
    http = b"HTTP/1.0 200 OK\r\nContent-Length: 999\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(http).digest()).decode()
    records = [
        foreign("warcinfo", b"software: other\r\n", "<urn:uuid:0>", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.0\r\n\r\n", "<urn:uuid:1>", "WARC-Concurrent-To: <urn:uuid:2>", "WARC-Concurrent-To: <urn:uuid:3>"),
        foreign("response", http, "<urn:uuid:2>", "Content-Type:application/http;msgtype=response", "WARC-Target-URI: http://x/", "WARC-Block-Digest: " + sha1, "X-Note: folded", "\tover two lines"),
        foreign("revisit", b"", "<urn:uuid:4>", "WARC-Refers-To: <urn:uuid:2>", "WARC-Payload-Digest: sha1:ABC"),
        foreign("resource", b"raw bytes", "urn:x", "WARC-Payload-Digest: md5:" + hashlib.md5(b"raw bytes").hexdigest()),
    ]
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "plain.warc.zst").write_bytes(b"".join(map(pack, records)))
    raw = b"WARC/1.0 warc-type content-length " * 20
    own = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress
    (tmp_path / "dictionary.warc.zst").write_bytes(struct.pack("<II", 0x184D2A5D, len(raw)) + raw + b"".join(map(own, records[:3])) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + own(records[3]))
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    rows = read_warc(spark, f"file://{tmp_path}").collect()
    assert collections.Counter(r.record_type for r in rows) == {"warcinfo": 2, "request": 2, "response": 2, "revisit": 2, "resource": 1}
    r = next(r for r in rows if r.record_type == "response")
    assert (r.page_id, r.payload, r.payload_bytes, r.record_id, r.target_uri) == (None, body, len(body), "<urn:uuid:2>", "http://x/")
    r = next(r for r in rows if r.record_type == "revisit")
    assert (r.refers_to_id, r.payload_digest, r.payload) == ("<urn:uuid:2>", "sha1:ABC", None)
    assert ("X-Note", "folded over two lines") in decode_record(records[2]).headers
    assert [v for k, v in decode_record(records[1]).headers if k == "WARC-Concurrent-To"] == ["<urn:uuid:2>", "<urn:uuid:3>"]
    for bad in (records[2].replace(b"hello", b"hullo"), records[4].replace(b"raw", b"row"), records[0].replace(b"warc-type:warcinfo", b"warc-type:"), records[0].replace(b"WARC/1.0", b" x")):
        with pytest.raises(ValueError):
            decode_record(bad)


def test_warc_record_ids_are_unique(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (1, "u", "x" * 200), (None, "u", "y"), (None, "u", "y")], "page_id long, url string, html string")
    write_warc(with_revisits(pages), f"file://{tmp_path}/w")
    ids = [r.record_id for r in read_warc(spark, f"file://{tmp_path}/w").collect()]
    assert len(ids) == len(set(ids)) == 4 and all(i.startswith("<urn:uuid:") for i in ids)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:110] = v[51]  # a very common vector, with ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[3].tolist()), (20, v[20].tolist()), (3, v[3].tolist()), (40, v[51].tolist())]
    useless = [(400, None), (401, [float("nan")] * 8), (402, [None] + [1.0] * 7), (None, v[0].tolist()), (403, [1.0] * 5), (405, [])]
    frame = spark.createDataFrame(rows + useless, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("shard", "row", "id", "v", "query", "score", "rank")})
    points = integer_vectors(frame)
    whole = [(i, np.floor(np.array(x, np.float32).astype(float) * 64).astype(int)) for i, x in rows]
    want = []
    for a, (q, x) in enumerate(whole):
        if q % 20 == 0:
            best = sorted((-int(x @ y), c) for b, (c, y) in enumerate(whole) if a != b)[:20]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    for sizes in ({}, {"shard_rows": 7, "leaf": 2}):
        visits = []
        assert sorted(map(tuple, exact_top_k(points, F.col("id") % 20 == 0, 20, visits=visits, **sizes).collect())) == sorted(want)
        assert sum(visits) > 0
    assert exact_top_k(points.where("id < 3"), F.col("id") == 0, 20).count() == 2
    assert exact_top_k(points.limit(0), F.col("id") == 0).count() == 0
    huge = integer_vectors(spark.createDataFrame([(0, [3e9, 1.0]), (1, [3e9, 5.0]), (2, [-3e9, 0.0])], "vec_id long, embedding array<double>"))
    assert [(r.vec_id, r.score) for r in exact_top_k(huge, F.col("id") == 0, 2).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_top_k_sends_queries_only_where_their_bound_reaches(spark):
    """Vectors in tight clusters: most leaves can't hold a neighbour, and are never sent to."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(24, 6)) * 10
    v = (centres[np.arange(1200) % 24] + rng.normal(size=(1200, 6)) * 0.1).tolist()
    points = integer_vectors(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"))
    visits = []
    got = exact_top_k(points, F.col("id") % 20 == 0, 20, shard_rows=50, visits=visits).collect()
    whole = np.floor(np.array(v) * 64).astype(int)
    want = [(q, r + 1, c, -s) for q in range(0, 1200, 20) for r, (s, c) in enumerate(sorted((-int(whole[q] @ whole[c]), c) for c in range(1200) if c != q)[:20])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(visits) < 60 * 24 / 2


@pytest.mark.parametrize("order,packed", [(2, True), (3, True), (3, False)])
def test_language_model_matches_formulas(docs, empty, monkeypatch, order, packed):
    from shardloom.llm import ngramlm

    if not packed:  # as if numbers were too large for 64 bits
        monkeypatch.setattr(ngramlm, "_keys", lambda columns: None)
    rows = corpus()
    tokens = [words_of(t) + ["<end>"] for _, t, _ in rows]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    train = [t for (k, _, _), t in zip(rows, tokens) if not held(k)]
    c = collections.Counter(w for t in train for w in t)
    total, size = sum(c.values()), len(c)
    grams = lambda t: zip(*[(["<s>"] * (order - 1) + t)[i:] for i in range(order)])
    counts = {order: collections.Counter(g for t in train for g in grams(t))}
    for m in range(order, 1, -1):  # different words before, but after a start mark the counts themselves
        counts[m - 1] = collections.Counter()
        for g, n in counts[m].items():
            counts[m - 1][g[1:]] += n if g[1] == "<s>" else 1

    def cut(values):
        n = collections.Counter(values)
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [0.0] + [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]

    less = {m: cut(counts[m].values()) for m in counts}
    after, kept = collections.Counter(), collections.Counter()
    for m in counts:
        for g, n in counts[m].items():
            after[m, g[:-1]] += n
            kept[m, g[:-1]] += less[m][min(n, 3)]

    def chance(g):
        m, h = len(g), (len(g), g[:-1])
        low = chance(g[1:]) if m > 1 else 1 / (size + 1)
        n = counts[m][g]
        return max(n - less[m][min(n, 3)], 0) / after[h] + kept[h] / after[h] * low if after[h] else low

    for h in (("<s>",) * (order - 1), (*("<s>",) * (order - 2), tokens[0][0])):
        assert sum(chance((*h, w)) for w in c) + chance((*h, "never seen")) == pytest.approx(1)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = kneser_ney_scores(docs, ~fold, order).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=lambda r: (r[0] is None, r[0], r[1]))
    want = sorted(((k, len(t), sum(w in c for w in t), total, sum(math.log10((c[w] + 1) / (total + size + 1)) for w in t), sum(math.log10(chance(g)) for g in grams(t))) for (k, _, _), t in zip(rows, tokens)), key=lambda r: (r[0] is None, r[0], r[1]))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:])
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in out)
    if packed and order == 2:
        assert kneser_ney_scores(empty, F.lit(True)).count() == 0
        assert {r.score for r in kneser_ney_scores(docs, F.lit(False)).collect()} == {0.0}


def test_quality_learns_and_bears_anything(spark, docs, empty, labels):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40) if i % 4 else " ".join(w + "$$$" for w in prose(rng, 40).split())) for i in range(200)]
    texts = spark.createDataFrame(rows + [(500, None), (501, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(120)], "doc_id long, quality int")
    out = score_quality(texts, fit_quality(texts, marks))
    held = [r for r in out.collect() if 120 <= r.doc_id < 200]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert score_quality(docs, fit_quality(docs, labels)).count() == docs.count()
    assert score_quality(empty, fit_quality(empty, labels)).count() == 0
    assert score_quality(texts, fit_quality(texts, marks.limit(0))).select("score").distinct().count() == 1


def test_toxicity_learns_and_bears_anything(spark, docs, empty, labels):
    rng = random.Random(4)
    bad = ["grobbel", "snarf", "vilepot"]
    rows = []
    for i in range(300):
        w = prose(rng, 60).split()
        for _ in range((i % 3 == 0) * rng.choice([1, 5])):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ".", "ish"]))
        rows.append((i, " ".join(w)))
    texts = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_toxicity(texts, fit_toxicity(texts, marks)).collect()}
    assert np.mean([out[i].toxic == (i % 3 == 0) for i in range(200, 300)]) > 0.95
    assert not out[900].toxic and out[900].severity == out[901].severity
    many = [out[i].severity for i in range(0, 300, 3) if sum(b in rows[i][1] for b in bad) == 3]
    one = [out[i].severity for i in range(0, 300, 3) if sum(rows[i][1].count(b) for b in bad) == 1]
    assert np.mean(many) > np.mean(one)
    for table, given in ((docs, labels), (empty, labels), (docs, labels.limit(0))):
        assert score_toxicity(table, fit_toxicity(table, given)).count() == table.count()


def test_ordinal_thresholds_are_ordered_and_grades_separate():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 600)
    parts = [np.unique(np.concatenate([rng.choice(20, 4), 100 + np.arange(3 * g)])) for g in grades]
    index = np.concatenate(parts)
    keys, at = np.unique(index, return_inverse=True)
    rows = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    model = fit_ordinal(keys.astype(np.uint32), at, rows, grades)
    assert (np.diff(model.thresholds) > 0).all()
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    score = np.array([sum(weight.get(k, 0) for k in p.tolist()) for p in parts])
    expected = model.above(score).sum(1)
    means = [expected[grades == g].mean() for g in range(4)]
    assert means == sorted(means) and abs(means[3] - 3) < 0.5 and means[0] < 0.5


def test_pipeline_stages_hold_on_small_tables(spark, tmp_path, docs, labels):
    import corpus_pipeline

    path = str(tmp_path)
    frame = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.char_length("text").cast("long").alias("n_chars"))
    frame.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, corpus()[12][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, path)
        assert kept.columns[: len(before.columns)] == before.columns, name
        kept = kept.cache()
        assert kept.count() > 0, name
    assert 12 not in {r.doc_id for r in kept.collect()}


def greedy_coverage(item, text, least):
    """Plain greedy string tiling: the longest common run of unmarked words, leftmost in the text, then in the item."""
    free_i, free_t, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for b in range(len(text)):
            for a in range(len(item)):
                k = 0
                while a + k < len(item) and b + k < len(text) and item[a + k] == text[b + k] and free_i[a + k] and free_t[b + k]:
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        k, a, b = best
        if k < least:
            return covered
        free_i[a : a + k] = free_t[b : b + k] = [False] * k
        covered += k


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_decontamination_equals_tiling_of_all_pairs(spark, monkeypatch, block_words):
    from shardloom.llm import decontaminate as module

    monkeypatch.setattr(module, "BLOCK_WORDS", block_words)
    rng = random.Random(21)
    vocabulary = ["w" + str(i) for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (40, 40, 12, 7, 4, 3, 2, 60)]
    items.append(list(items[0]))
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            i = rng.choice(items)
            a = rng.randrange(len(i))
            words += i[a : a + rng.randint(1, 25)] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))]
        texts.append(words)
    texts.append(["zz", *items[0][:19], "yy"])
    bench = spark.createDataFrame([(100 - i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"coverage": F.lit("mine"), "ITEM_ID": F.lit(5)})
    out = decontaminate(docs, bench)
    assert out.columns == ["doc_id", "text", "coverage", "item_id"]
    for r in out.collect():
        shares = []
        for i, x in enumerate(items):
            t = texts[r.doc_id]
            whole = any(t[k : k + len(x)] == x for k in range(len(t)))
            shares.append((-(1.0 * whole if len(x) < 4 else greedy_coverage(x, t, 4) / len(x)), 100 - i))
        share, item = min(shares)
        assert r.coverage == pytest.approx(-share) and r.item_id == (item if -share >= 0.5 else None), r
    assert next(r.coverage for r in out.collect() if r.doc_id == 60) == pytest.approx(19 / 40)


def naive_windows(texts, length):
    """Bytes that go and runs of them, by text, from a count of all windows."""
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())))
    return out


def test_suffix_dedup_bears_one_line_in_many_contexts(spark, monkeypatch):
    """The bucket of a common line is larger than a task may hold: its windows go on one by one, results stay the same."""
    from shardloom.llm import suffixdedup as module

    rng = random.Random(17)
    line = " ".join(prose(rng, 60))[:200]
    texts = [" ".join(prose(rng, 12)) + line + " ".join(prose(rng, 12)) for _ in range(300)] + [" ".join(prose(rng, 80)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = naive_windows([t.encode() for t in texts], 200)
    for chunk in (4 << 20, 4000):
        monkeypatch.setattr(module, "CHUNK", chunk)
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want
    held, real = [], module.repeated_windows
    monkeypatch.setattr(module, "repeated_windows", lambda segments, several, length: held.append(sum(map(len, segments))) or real(segments, several, length))
    rows = [(7, i, 0, 0, t.encode()[:230], False) for i, t in enumerate(texts)] + [(9, 900 + i, 0, 0, t.encode()[-230:], False) for i, t in enumerate(texts[:10])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], ["bucket", "c1", "start", "size", "segment", "several"])
    out = pa.Table.from_batches(list(module._repeats(200, 4000)(iter([batch]))))
    assert held and max(held) <= 2 * 4000 + 300
    spilled = out.filter(pa.compute.is_valid(out["segment"]))
    assert set(zip(spilled["c1"].to_pylist(), spilled["lo"].to_pylist())) == {(i, j) for i in range(len(texts)) for j in range(31)}


def test_common_prefixes_have_their_lengths():
    from shardloom.llm.suffixdedup import common_prefixes

    rng = np.random.default_rng(3)
    text = rng.integers(0, 2, 400).astype(np.uint8)
    a, b = rng.integers(0, 350, 300), rng.integers(0, 350, 300)
    for depth in (5, 8, 30, 50):
        want = [next((k for k in range(depth) if text[x + k] != text[y + k]), depth) for x, y in zip(a, b)]
        assert common_prefixes(text, a, b, depth).tolist() == want


def test_texts_with_equal_halves_of_keys_stay_apart(spark):
    from shardloom.llm.suffixdedup import apart, clashing_keys

    rows = spark.createDataFrame([(1, 5, 6), (2, 5, 7), (3, 5, 7), (4, 8, 8)], "doc_id long, c1 long, c2 long")
    out = {r.doc_id: r.c1 for r in apart(rows, clashing_keys(rows)).collect()}
    assert out[4] == 8 and out[2] == out[3] and len({out[1], out[2], out[4]}) == 3
    assert clashing_keys(rows.where("doc_id > 1")) is None


def test_quality_training_and_scores_follow_the_formulas(spark):
    """The gradient of the step against finite differences, and scores against a plain recomputation."""
    from shardloom.llm import quality as module

    index = [np.array([3, 9], np.int32), np.array([9, 11], np.int32)]
    count = [np.array([1, 2], np.float32), np.array([1, 1], np.float32)]
    label = np.array([0, 1])
    rng = np.random.default_rng(3)
    dim = 4
    vectors, out, bias = rng.uniform(-1 / dim, 1 / dim, (module.REPEAT + 1, dim)), rng.normal(size=(2, dim)), rng.normal(size=2)

    def loss(v, o, b, r):
        w = count[r] / count[r].sum()
        odds = o @ (w @ v[index[r]]) + b
        return np.log(np.exp(odds).sum()) - odds[label[r]]

    for r in (0, 1):
        w = count[r] / count[r].sum()
        mean = w @ vectors[index[r]]
        p = np.exp(out @ mean + bias)
        g = p / p.sum()
        g[label[r]] -= 1
        for i, d in ((0, 1), (1, 3)):
            moved = vectors.copy()
            moved[index[r][i], d] += 1e-6
            assert (loss(moved, out, bias, r) - loss(vectors, out, bias, r)) / 1e-6 == pytest.approx((w[i] * (g @ out))[d], abs=1e-4)
            step = out.copy()
            step[i, d] += 1e-6
            assert (loss(vectors, step, bias, r) - loss(vectors, out, bias, r)) / 1e-6 == pytest.approx(np.outer(g, mean)[i, d], abs=1e-4)
    assert module.train(index * 40, count * 40, np.tile(label, 40)).table[11] > module.train(index * 40, count * 40, np.tile(label, 40)).table[3]
    model = module.QualityModel(rng.normal(size=module.REPEAT + 1).astype(np.float32), 0.3)
    texts = ["Abc abc abc d", "", "é"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in score_quality(frame, model).orderBy("doc_id").collect()]
    for text, score in zip(texts, got):
        data, offsets = _text.buffer(pa.array([text]))
        values = np.concatenate([v for v, _ in module.features(data, offsets)]) if text else np.zeros(0, int)
        assert score == pytest.approx(1 / (1 + math.exp(-((model.table[values].mean() if len(values) else 0) + 0.3))), rel=1e-5)
    data, offsets = _text.buffer(pa.array(["a a b b b"]))
    assert sum(int((v == module.REPEAT).sum()) for v, _ in module.features(data, offsets)) == 3


def test_ordinal_gradient_is_that_of_the_likelihood():
    """One step from zero weights goes down the likelihood's gradient, by finite differences."""
    from shardloom.llm.toxicity import scores

    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 60)
    parts = [np.unique(rng.choice(8, 3)) for _ in grades]
    at = np.concatenate(parts)
    rows = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    share = np.array([(grades > k).mean() for k in range(2)])
    theta = np.log((1 - share) / share)

    def loss(w, theta=theta):
        s = np.array([w[p].sum() for p in parts])
        above = np.concatenate([np.ones((60, 1)), 1 / (1 + np.exp(-(s[:, None] - theta))), np.zeros((60, 1))], 1)
        return -np.log(above[np.arange(60), grades] - above[np.arange(60), grades + 1]).mean()

    slope = np.array([(loss(np.eye(8)[j] * 1e-6) - loss(np.zeros(8))) / 1e-6 for j in range(8)])
    model = fit_ordinal(np.arange(8, dtype=np.uint32), at, rows, grades, penalty=0.0, steps=1, rate=1e-3)
    weight = np.zeros(8)
    weight[model.keys] = model.weights
    assert (np.sign(weight) == -np.sign(slope)).all()
    long = fit_ordinal(np.arange(8, dtype=np.uint32), at, rows, grades, penalty=0.0, steps=50)
    best = np.zeros(8)
    best[long.keys] = long.weights
    assert loss(best, long.thresholds) < loss(np.zeros(8))
    assert scores(long, at.astype(np.uint32), rows) == pytest.approx([best[p].sum() for p in parts])


def test_toxicity_severity_is_the_sum_of_chances(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 30).split() + ["snarf", "grobbel"] * (i % 3 == 0) * (1 + i % 2))) for i in range(240)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = fit_toxicity(texts, marks)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    from shardloom.llm.toxicity import word_features

    for r in score_toxicity(texts, model).collect():
        data, offsets = _text.buffer(pa.array([r.text]))
        x = sum(weight.get(k, 0.0) for k in {int(i) for values, _ in word_features(data, offsets) for i in values})
        above = [1 / (1 + math.exp(-(x - t))) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(above)) and r.toxic == (above[0] >= model.reject_at)


def test_training_samples_are_bounded_by_ids(spark):
    from shardloom.llm.quality import labelled_sample

    texts = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, "c"), (4, "d"), (None, "e")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in (1, 1, 2, 3, 4)], "doc_id long, quality int")
    got = [labelled_sample(texts.repartition(n), marks, "quality", F.lit(True), 3).collect() for n in (1, 5)]
    assert len(got[0]) == 3 and sorted(got[0]) == sorted(got[1])
    assert len(labelled_sample(texts, marks, "quality", F.lit(True), 1, per_label=True).collect()) == 2


OPERATORS = {
    "score_quality": (lambda docs, labels, bench: score_quality(docs, fit_quality(docs, labels)), ["score"]),
    "score_toxicity": (lambda docs, labels, bench: score_toxicity(docs, fit_toxicity(docs, labels)), ["severity", "grade", "toxic"]),
    "kneser_ney_scores": (lambda docs, labels, bench: kneser_ney_scores(docs, F.lit(True)), ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]),
    "decontaminate": (lambda docs, labels, bench: decontaminate(docs, bench), ["coverage", "item_id"]),
    "mixed_documents": (lambda docs, labels, bench: mixed_documents(docs), ["copy"]),
    "mix_sources": (lambda docs, labels, bench: mix_sources(docs), None),
    "ngram_components": (lambda docs, labels, bench: ngram_components(docs), None),
    "one_of_each": (lambda docs, labels, bench: one_of_each(docs), []),
    "substring_dedup": (lambda docs, labels, bench: substring_dedup(docs), None),
    "passage_dedup": (lambda docs, labels, bench: passage_dedup(docs), None),
    "without_repeats": (lambda docs, labels, bench: without_repeats(docs), []),
}
CLASHES = ["score", "severity", "Grade", "toxic", "coverage", "item_id", "copy", "n_tokens", "n_known", "train_tokens", "base_score", "perplexity", "_c1", "_c2", "c1", "c2", "class", "component", "component_id", "n_shingles", "_spans", "_cut", "_b", "_of", "doc", "nth", "of", "b", "a", "k1", "k2", "_k1", "_copies", "copies", "n", "size", "taken", "target", "label", "index", "hub", "cell", "runs", "held_out", "predicted"]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_bear_columns_with_their_own_names(spark, labels, name):
    run, adds = OPERATORS[name]
    bench = spark.createDataFrame([(0, corpus()[12][1])], "item_id long, text string")
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 2000][-30:]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marked = plain.withColumns({c: F.lit("mine") for c in CLASHES})
    want, got = run(plain, labels, bench), run(marked, labels, bench)
    if adds is None:
        assert got.columns == want.columns
    else:
        kept = [c for c in marked.columns if c.lower() not in {a.lower() for a in adds}]
        assert got.columns[: len(kept)] == kept and sorted(got.columns[len(kept) :]) == sorted(adds)
        got = got.select(*want.columns)
    text = lambda r: repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
    assert sorted(map(text, got.collect())) == sorted(map(text, want.collect()))


def test_pipeline_runs_whole_and_leaves_only_its_result(spark, tmp_path, docs, empty, labels):
    import corpus_pipeline
    from shardloom.llm._spark import shared_dir

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    for name, table, marks in (("some", docs, labels), ("none", empty, labels.limit(0))):
        path = f"{tmp_path}/{name}"
        frame = table.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.char_length("text").cast("long").alias("n_chars"), F.lit(1).alias("_toxic"), F.lit("x").alias("_coverage"))
        frame.write.parquet(f"{path}/documents.parquet")
        marks.write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(0, corpus()[12][1])], "item_id long, text string").limit(1 if name == "some" else 0).write.parquet(f"{path}/benchmark.parquet")
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        out = corpus_pipeline.run(spark, path)
        left = set(os.listdir(folder)) - before
        assert len(left) == 1 and next(iter(left)).startswith("pipeline-mixing")
        assert out.columns == [*frame.columns, "copy"] and (out.count() > 0) == (name == "some")
