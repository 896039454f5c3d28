import random

from pyspark.sql import functions as F

from tripleloom.functions import collections as C


def test_lists_are_sorted_and_without_repeats(spark):
    r = random.Random(3)
    data = [([r.randint(-9, 9) for _ in range(r.randint(0, 12))] + [None] * r.randint(0, 1), r.randint(-9, 9)) for _ in range(60)]
    df = spark.createDataFrame(data, "v array<int>, x int").withColumn("l", C.sorted_list(F.col("v")))
    x, items = F.col("x"), F.col("l")
    got = df.select("v", "x", "l", C.insert(items, x).alias("i"), C.delete(items, x).alias("d"), C.index(items, x).alias("at"), C.bisect_left(items, x).alias("bl"), C.bisect_right(items, x).alias("br"), C.in_order(items, True).alias("down"))
    for row in got.collect():
        want = sorted({e for e in row.v if e is not None})
        assert row.l == want and row.i == sorted({*want, row.x}) and row.d == [e for e in want if e != row.x]
        assert row["at"] == (want.index(row.x) if row.x in want else None)
        assert (row.bl, row.br) == (sum(e < row.x for e in want), sum(e <= row.x for e in want)) and row.down == want[::-1]


def test_maps(spark):
    r = random.Random(4)
    data = [({r.randint(0, 9): r.randint(0, 9) for _ in range(r.randint(0, 8))}, r.randint(0, 9)) for _ in range(40)]
    df = spark.createDataFrame(data, "m map<int,int>, x int")
    m, x = F.col("m"), F.col("x")
    got = df.select("m", "x", F.map_entries(C.sorted_map(m)).alias("s"), F.map_entries(C.put(m, x, F.lit(77))).alias("p"), C.get_or(m, x, F.lit(-1)).alias("g"), C.get_many(m, F.array(x, x + 1)).alias("many"), C.remove(m, x).alias("r"))
    for row in got.collect():
        assert list(map(tuple, row.s)) == sorted(row.m.items()) and list(map(tuple, row.p)) == sorted({**row.m, row.x: 77}.items())
        assert row.g == row.m.get(row.x, -1) and row.many == {k: v for k, v in row.m.items() if k in (row.x, row.x + 1)} and row.r == {k: v for k, v in row.m.items() if k != row.x}
