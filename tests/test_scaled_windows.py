"""Window queries on dense and odd tables, against plain loops."""

import random
import re
from bisect import bisect_left, bisect_right

from corpusweave.operators import windows


def test_rolling_rate_without_sliding_frames(spark, tmp_path):
    rng = random.Random(4)
    half = 1_800_000_000
    at = sorted(rng.choice([rng.randrange(-3 * half, 3 * half), rng.randrange(-4, 4) * half, rng.randrange(0, half // 9)]) for _ in range(1500))
    spark.createDataFrame(list(enumerate(at)), "event_id long, us long").selectExpr("event_id", "CAST(timestamp_micros(us) AS TIMESTAMP_NTZ) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = windows.WINDOWS["win_rolling_rate"].run(spark, str(tmp_path))
    want = {}
    for i, t in enumerate(at):
        low, high = bisect_left(at, t - half), bisect_right(at, t)
        if high - low >= 2 and t - at[low] >= 120_000_000:
            want[i] = round((high - low - 1) / ((t - at[low]) / 1e6), 6)
    rates = {r["event_id"]: r["rate"] for r in got.collect()}
    assert rates.keys() == want.keys() and len(want) > 1000
    assert all(abs(rates[i] - want[i]) < 2e-6 for i in want)
    assert "-1800000000" not in got._jdf.queryExecution().toString()


def test_tiling_check_deals_a_large_table_into_more_partitions(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    lines = [(o, n, rng.randrange(50), float(rng.randrange(4))) for o in range(300) for n in range(rng.randrange(1, 9))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    query = windows.WINDOWS["win_tiling_check"]
    want = sorted(map(tuple, query.run(spark, str(tmp_path)).collect()))
    monkeypatch.setattr("corpusweave.plans.sql.ROWS", 50)
    got = query.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 300
    parts, plan = -(-len(lines) // 50), got._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\(l_orderkey[^)]*, (\d+)\)", plan)) == {str(parts)}
    assert got.rdd.getNumPartitions() == parts  # rows that a task sorts stay alike
