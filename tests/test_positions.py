"""The blocked numbering equals a plain whole-group window, with many blocks per key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatprep.operators.positions import number_rows, block_of


def test_block_of_negative(spark):
    df = spark.createDataFrame([(-5,), (-4,), (-1,), (0,), (3,), (4,)], "x bigint")
    got = [r.b for r in df.select(block_of("x", 4).alias("b")).orderBy("x").collect()]
    assert got == [-2, -1, -1, 0, 0, 1]


def test_number_rows_matches_window(spark):
    rnd = random.Random(7)
    rows = []
    for key in range(6):
        ident = rnd.randint(-40, 40)
        for _ in range(rnd.choice([0, 1, 5, 60, 300])):
            ident += rnd.choice([1, 1, 2, 9])
            rows.append((key % 4, ident, rnd.randint(1, 30)))   # keys 0 and 1 get two histories
    df = spark.createDataFrame(rows, "k bigint, id bigint, v bigint")
    got = number_rows(df, ["k"], ["id", "v"], block_col="id", width=7, sums={"run": F.col("v")},
                      total_col="n", sum_totals=True)
    w = Window.partitionBy("k").orderBy("id", "v")
    want = df.withColumn("pos", F.row_number().over(w) - 1) \
        .withColumn("run", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))) \
        .withColumn("run_total", F.sum("v").over(Window.partitionBy("k")))
    cols = ["k", "id", "v", "pos", "run", "n", "run_total"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_hot_chat_is_spread(spark):
    """One chat with all rows: the exchange before the window is keyed by block."""
    df = spark.range(0, 5000).select(F.lit(1).cast("bigint").alias("chat_id"), F.col("id"))
    out = number_rows(df, ["chat_id"], ["id"], block_col="id", width=500)
    assert out.agg(F.max("pos")).first()[0] == 4999
    tasks = out.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert tasks > 1


def test_null_keys_and_orders_are_kept(spark):
    rows = [(None, 1), (None, 2), (1, None), (1, 5), (1, 6), (2, None)]
    df = spark.createDataFrame(rows, "k bigint, id bigint")
    got = sorted((r.k if r.k is not None else -1, r.id if r.id is not None else -1, r.pos, r.n)
                 for r in number_rows(df, ["k"], ["id"], block_col="id", width=2, total_col="n").collect())
    assert got == [(-1, 1, 0, 2), (-1, 2, 1, 2), (1, -1, 0, 3), (1, 5, 1, 3), (1, 6, 2, 3), (2, -1, 0, 1)]


def test_single_exchange_between_join_and_window(spark):
    """With a sort-merge join (no broadcast), the window reuses the join's partitioning:
    no exchange sits between them, so the data is shuffled once."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                                 "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        df = spark.range(0, 20000).select((F.col("id") % 3).alias("chat_id"), F.col("id"))
        out = number_rows(df, ["chat_id"], ["id"], block_col="id", width=1000)
        out.write.format("noop").mode("overwrite").save()
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
        start = next(i for i, l in enumerate(lines) if "row_number()" in l)
        stop = next(i for i, l in enumerate(lines) if i > start and "SortMergeJoin" in l)
        assert not any("Exchange" in l for l in lines[start:stop])
        assert not any("isnull(" in l for l in lines if "hashpartitioning" in l)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_ids_far_apart_and_repeated_across_chats(spark):
    """No density assumption: ids a million apart, and a global order over chats that repeat ids."""
    from chatprep.operators import context as C, segments as G, sequences as S, splits as P
    far = spark.range(3000).selectExpr("id % 3 as chat_id", "id * 1000000 as id", "timestamp_seconds(id) as sent_at",
                                       "'00:00' as hhmm", "concat('u', id % 2) as sender", "'hello' as text",
                                       "cast(null as bigint) as reply_to_message_id")
    rank = Window.partitionBy("chat_id").orderBy("id")
    got = number_rows(far, ["chat_id"], ["id"], block_col="id", dense=False, total_col="n", sums={"s": F.length("text")})
    want = far.withColumn("w", F.row_number().over(rank) - 1)
    assert got.join(want.select("chat_id", "id", "w"), ["chat_id", "id"]).where("pos = w and n = 1000 and s = 5 * (w + 1)").count() == 3000
    segs = G.segment_fixed(far, 10, dense=False)
    assert segs.groupBy("chat_id", "seg_id").count().where("count = 10").count() == 300
    ctx = C.context_at_each_message(far, F.length("text"), 12, dense=False)
    assert ctx.where("n_context = 2").count() == 2997
    same = far.withColumn("id", (F.col("id") / 3_000_000).cast("bigint"))  # 0..999 in every chat
    whole = S.positions(S.with_scope(same, "global"))
    assert whole.where("pos = source_chat_id * 1000 + id and n_chat = 3000").count() == 3000
    train = P.split_ordered(same, "id", 0.5).where("split = 'train'")
    assert train.count() == 1500 and train.agg(F.max("id")).first()[0] == 499


def test_ranges_bound_the_largest_group(spark):
    from chatprep.operators.positions import _by_range
    x = spark.range(100_000).selectExpr("struct(1) as _gk", "id * 1000003 as id")
    sizes = [r["count"] for r in _by_range(x, ["id"]).groupBy("_blk").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 100_000 / len(sizes)


def test_repeated_sparse_and_null_ids_need_no_hint(spark, monkeypatch):
    """Defaults: one id that holds most rows, ids far apart and null ids are numbered like a plain
    window, and no block passes its bound."""
    from chatprep.operators import positions as P, sequences as S, segments as G
    df = spark.range(20_000).selectExpr("1L as chat_id", "case when id % 10 < 7 then 5L when id % 10 = 9 then null else id * 99991 end as id",
                                        "id as v", "'x' as text")
    w = Window.partitionBy("chat_id").orderBy("id", "v")
    want = {r.v: r.pos for r in df.withColumn("pos", F.row_number().over(w) - 1).collect()}
    seen = []
    ranges = P._by_range
    monkeypatch.setattr(P, "_by_range", lambda x, order: seen.append(ranges(x, order)) or seen[-1])
    got = number_rows(df, ["chat_id"], ["id", "v"], block_col="id", width=1000, total_col="n", sums={"s": F.lit(1)})
    assert {r.v: r.pos for r in got.collect()} == want
    assert got.where("n = 20000 and s = pos + 1").count() == 20_000
    sizes = [r["count"] for r in seen[0].groupBy("_blk").count().collect()]
    assert len(seen) == 1 and max(sizes) < 2 * 20_000 / len(sizes)
    # rows that agree in the whole order are split too, and positions stay a permutation
    same = number_rows(df.select("chat_id", F.lit(5).alias("id")), ["chat_id"], ["id"], block_col="id", width=1000)
    sizes = [r["count"] for r in seen[1].groupBy("_blk").count().collect()]
    assert max(sizes) < 2 * 20_000 / len(sizes)
    assert same.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (20_000, 0, 19_999)
    # few blocks are allowed: ids far apart go to ranges
    monkeypatch.setattr(P, "MAX_BLOCKS", 100)
    far = df.select("chat_id", (F.col("v") * 1_000_003).alias("id"), "text")
    assert number_rows(far, ["chat_id"], ["id"], block_col="id").where("pos = id / 1000003").count() == 20_000
    assert len(seen) == 3
    chunks = S.chunk_fixed(S.positions(far), 15).groupBy("seq_id").count()
    assert chunks.count() == 1333 and chunks.where("count <> 15").count() == 0
    assert G.segment_fixed(far, 10).groupBy("seg_id").count().where("count = 10").count() == 2000
    assert len(seen) == 5


def test_ids_in_blocks_are_not_dealt_out(spark, monkeypatch):
    from chatprep.operators import positions as P
    monkeypatch.setattr(P, "_by_range", lambda *a: 1 / 0)
    df = spark.range(5000).selectExpr("id % 2 as chat_id", "id")
    assert number_rows(df, ["chat_id"], ["id"], block_col="id", width=100).agg(F.max("pos")).first()[0] == 2499
    assert number_rows(df.limit(0), ["chat_id"], ["id"], block_col="id").count() == 0
