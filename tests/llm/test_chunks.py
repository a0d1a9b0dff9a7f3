"""The layout of exchanges, joins on hot keys, components, columns under numbers."""

import random

from candlewick.llm import chunks
from candlewick.llm.components import components


def test_layout_keeps_tokens_together_at_any_size():
    for total in (0, 10**6, 10**9, 3 * 10**10, 10**14):
        for width in (6.0, 15.0):
            chunk_bytes, buckets = chunks.layout(total, width)
            assert chunk_bytes >= chunks.CHUNK_BYTES - width and buckets >= 8
            if total >= 10**9:
                assert chunk_bytes / width / buckets >= chunks.ROW_TOKENS * 0.99
                assert chunk_bytes < 128 << 20 and total / width / buckets < 64 << 20


def test_hot_keys_join_like_others(spark):
    r = random.Random(1)
    rows = [(0, i) for i in range(300)] + [(r.randint(1, 5000), i) for i in range(600)] + [(None, 7)]
    left = spark.createDataFrame(rows, "k bigint, v bigint")
    counts = left.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n").withColumn("own", chunks.F.col("k") * 2)
    got = chunks.join_each(left, counts, "k", 901)
    assert sorted(map(tuple, got.select("k", "v", "own").collect())) == sorted((k, v, 2 * k) for k, v in rows if k is not None)
    assert chunks.join_each(left.limit(0), counts.limit(0), "k", 0).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(220)] + [(900, 500 + i) for i in range(60)] + [(600 + i, 601 + i) for i in range(40)] + [(3, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_columns_under_numbers(spark):
    df = spark.createDataFrame([(1, "x", 2)], "`a b` int, C0 string, c1 int")
    own = chunks.numbered(df)
    assert own.columns == ["c0", "c1", "c2"] and chunks.number_of(df, "C0") == "c1"
    assert chunks.restored(own, df).collect() == df.collect() and chunks.restored(own, df).columns == df.columns


def test_a_stored_table_outlives_its_name(spark):
    docs = spark.createDataFrame([(i, "text " * i) for i in range(50)], "id bigint, text string").repartition(3)
    before = {t.name for t in spark.catalog.listTables()}
    stored, buckets = chunks.store(docs, "text", 6.0)
    assert {t.name for t in spark.catalog.listTables()} == before and buckets == 8
    rows = [r for x in stored.collect() for r in chunks.rows_of(bytes(x.blob)).column(0).to_pylist()]
    assert sorted(rows) == list(range(50))
    joined = stored.join(spark.createDataFrame([(x.chunk, 1) for x in stored.collect()], "chunk bigint, one int").hint("merge"), "chunk")
    assert joined.count() == stored.count() and joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
