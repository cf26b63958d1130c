"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: the total is shared by weight, no
source gets more than ``cap`` times what it has, and what is cut off is shared
again among the others.  A document of a source with target / size = r is
taken floor(r) times for certain and once more with probability r - floor(r).

These probabilities are rounded in pairs.  Of two documents that are still
fractional, words move from one to the other, either way round with the odds
that keep both expectations, until one of them is 0 or 1.  The words of a
source therefore stay at its target, up to the last document.  Pairs are made
within small buckets of a source; what each bucket leaves over, one document
at most, meets the leftovers of ``fan`` other buckets on the next level of a
tree, down to one document for each source.  So a source with a third of all
rows is many tasks.  All odds come from hashes of the rows: reruns agree.

Equal rows are counted before they are dealt, and travel as one row for each
``bucket`` of them, so a document that is a third of all rows is many tasks too.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; null and repeated ids are rows of their own; repeated rows are
rounded separately; documents of size 0 are rounded independently; an empty
table gives an empty result.  ``mix_sources`` reads only the named columns;
``mixed_documents`` keeps all, numbers the copies of equal rows together and
replaces a column named copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.llm._spark import discard, ship, spare, staged, without
from shardloom.llm._text import U64, mix

WORD = r"[^\x20\x09-\x0D]+"
#: Source tables of up to so many rows are broadcast, others joined by shuffle.
BROADCAST_SOURCES = 50_000
_FIELDS = "doc_id bigint, k1 bigint, k2 bigint, n bigint, source string, source_no bigint, size bigint, source_size bigint, target double, whole bigint, x double, bucket bigint"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_keys(parts: list[Column]) -> list[Column]:
    """128 bits that name a row by its content."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts, F.lit(1))]


def pivot(x: np.ndarray, size: np.ndarray, coins: np.ndarray, finish: bool) -> np.ndarray:
    """Round probabilities in the given order; with ``finish`` the last one too."""
    x, held = x.copy(), -1
    for i in range(len(x)):
        if x[i] <= 0.0 or x[i] >= 1.0:
            continue
        if size[i] == 0:
            x[i] = float(coins[i] < x[i])
            continue
        if held < 0:
            held = i
            continue
        j = held
        room_i, room_j = (1 - x[i]) * size[i], (1 - x[j]) * size[j]
        to_i, to_j = min(room_i, x[j] * size[j]), min(room_j, x[i] * size[i])
        a, b, moved, room = (i, j, to_i, room_i) if coins[i] * (to_i + to_j) < to_j else (j, i, to_j, room_j)
        filled, emptied = moved >= room, moved >= x[b] * size[b]
        x[a] = 1.0 if filled else x[a] + moved / size[a]
        x[b] = 0.0 if emptied else x[b] - moved / size[b]
        for k in (i, j):
            if x[k] < 1e-12 or x[k] > 1 - 1e-12:
                x[k] = round(x[k])
        held = next((k for k in (i, j) if 0.0 < x[k] < 1.0), -1)
    if finish and held >= 0:
        x[held] = float(coins[held] < x[held])
    return x


def _round(level: int, seed: int, finish: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        k1, k2 = (group[k].to_numpy().astype(np.int64) for k in ("k1", "k2"))
        order = np.lexsort((group["x"].to_numpy(), k2, k1))
        group = group.take(np.repeat(order, group["n"].to_numpy()[order]))
        salt = U64((seed * 1_000_003 + level) & ((1 << 64) - 1))
        coins = (mix(mix(group["k1"].to_numpy().view(U64) + salt) ^ mix(np.arange(group.num_rows, dtype=U64))) >> U64(11)).astype(float) / (1 << 53)
        x = pivot(group["x"].to_numpy(), group["size"].to_numpy().astype(float), coins, finish)
        return group.set_column(group.schema.get_field_index("x"), "x", pa.array(x)).set_column(group.schema.get_field_index("n"), "n", pa.array(np.ones(len(x), np.int64)))

    return run


def source_targets(sized: DataFrame, weights: tuple[float, ...], cap: float, share: float) -> DataFrame:
    """One row per source: source_no in code point order (null last), sizes, target.  Staged."""
    spark = sized.sparkSession
    order = (F.col("source").isNull(), F.col("source"))
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    dealt = sources.repartitionByRange(32, *order).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy(*order)
    ranked = staged(dealt.withColumn("pos", F.row_number().over(within)), "mix-sources")
    offsets, seen = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, seen))
        seen += n
    numbered = ranked.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part")
    number = F.col("before") + F.col("pos") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    numbered = numbered.select("source", "source_size", "docs", number.alias("source_no"), weight.alias("weight"))
    total, all_weight = numbered.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (share * total / all_weight if total else 0.0), -1
    limit = F.col("source_size") * float(cap)
    while total:
        over = limit <= F.col("weight") * level
        n, fixed, left = numbered.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not left:
            break
        capped, level = n, (share * total - (fixed or 0.0)) / left
    return numbered.withColumn("target", F.least(limit, F.col("weight") * level))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, share: float = 1.0, bucket: int = 2048, fan: int = 256, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source, and the row's content keys k1, k2."""
    spark = docs.sparkSession
    ship(spark)
    k1, k2 = row_keys([docs[id_col], docs[source_col], docs[text_col]])
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = staged(every.groupBy(*every.columns).agg(F.count("*").alias("n")), "mix-sizes")
    targets = source_targets(sized, weights, cap, share).withColumnRenamed("source", "name")
    n, most = targets.agg(F.count("*"), F.max("docs")).first()
    small = F.broadcast(targets) if n <= BROADCAST_SOURCES else targets
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = (
        sized.join(small, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("whole", F.floor(ratio))
        .withColumn("x", ratio - F.col("whole"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / bucket))))
        .withColumn("n", F.least(F.col("n") - F.col("part") * bucket, F.lit(bucket)))
        .withColumn("bucket", F.pmod(F.xxhash64("k1", "k2", "part"), F.ceil(F.col("docs") / bucket)))
        .select(*[f.split(" ")[0] for f in _FIELDS.split(", ")])
    )
    done, buckets, level = [], -(-(most or 0) // bucket), 0
    while True:
        finish = buckets <= 1
        rounded = staged(rows.groupBy("source_no", "bucket").applyInArrow(_round(level, seed, finish), _FIELDS), "mix-level")
        fractional = (F.col("x") > 0) & (F.col("x") < 1)
        done.append(rounded.where(~fractional))
        if finish:
            break
        rows = rounded.where(fractional).withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
        buckets, level = -(-buckets // fan), level + 1
    discard(spark, sized)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("x").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "k1", "k2")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its copy's number, from 1.

    Rows that are equal in all columns are one with the sum of their copies.
    """
    named = [options.get(o, c) for o, c in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))]
    docs = without(docs, ("copy",), tuple(named))
    held = lambda f: F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name)
    whole, part = row_keys([held(f) for f in docs.schema.fields]), row_keys([docs[c] for c in named])
    taken = mix_sources(docs, **options).groupBy("k1", "k2").agg(F.sum("copies").alias("all"), F.count("*").alias("n"))
    # rows of one id, source and text that differ elsewhere share their copies in order of their keys
    variants = docs.select(part[0].alias("k1"), part[1].alias("k2"), whole[0].alias("f1"), whole[1].alias("f2")).groupBy("k1", "k2", "f1", "f2").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("k1", "k2").orderBy("f1", "f2").rowsBetween(Window.unboundedPreceding, -1))
    shared = variants.withColumn("before", F.coalesce(before, F.lit(0))).join(taken, ["k1", "k2"])
    more = F.greatest(F.lit(0), F.least("rows", F.pmod("all", "n") - F.col("before")))
    f1, f2, copies = spare(docs, "_f1", "_f2", "_copies")
    chosen = shared.select(F.col("f1").alias(f1), F.col("f2").alias(f2), (F.floor(F.col("all") / F.col("n")) * F.col("rows") + more).alias(copies)).where(F.col(copies) > 0)
    rows = docs.withColumns({f1: whole[0], f2: whole[1]}).dropDuplicates([f1, f2])
    return rows.join(chosen, [f1, f2]).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("copy"))
