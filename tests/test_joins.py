from lodestrata.operators.joins import counted, lookup, lookup_hot


def test_hot_keys_apart_and_rows_whole(spark):
    """One key holds most rows, one a third of the rest; without a broadcast the result is the same."""
    rows = [("hot", i) for i in range(400)] + [(f"k{i % 40}", i) for i in range(120)] + [(None, 1), ("lost", 2)]
    big = spark.createDataFrame(rows, "k string, v int")
    small = spark.createDataFrame([("hot", "H"), ("unused", "U"), (None, "N")] + [(f"k{i}", f"K{i}") for i in range(40)], "k string, name string")
    want = sorted((k, v, "H" if k == "hot" else k.upper()) for k, v in rows if k and k != "lost")
    plan = lookup_hot(big, small.join(counted(big, "k"), "k"), "k")
    for out in (plan, lookup(big, small, "k"), lookup(big, small, "k", most=3), lookup(big, small, ["k"], written=True, most=0)):
        assert sorted(tuple(r) for r in out.select("k", "v", "name").collect()) == want
    assert lookup(big.limit(0), small, "k", most=0).count() == 0 and lookup(big, small.limit(0), "k").count() == 0
