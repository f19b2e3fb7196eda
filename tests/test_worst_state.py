from pyspark.sql import functions as F

from tidemark.operators.depth import worst_states


def test_the_least_excess_is_taken_and_depth_and_fees_decide(spark):
    hour = 3_600_000_000
    # grp 1 is wide at first and narrow later, grp 2 never covers its fees, grp 3 is too thin
    rows = [(1, 0, 1, 6000, 6000, 2000), (1, hour, 2, 5300, 5300, 2000), (1, 2 * hour, 3, 4000, 4000, 2000)]
    rows += [(2, 0, 4, 5050, 5050, 2000), (2, 2 * hour, 5, 4000, 4000, 2000), (3, 0, 6, 6000, 6000, 500), (3, 2 * hour, 7, 4000, 4000, 500), (4, 0, 8, 6000, 6000, 2000)]
    df = spark.createDataFrame(rows, "grp long, us long, id long, bid_0 long, bid_1 long, size long")
    got = {r.grp: r for r in worst_states(df, F.col("bid_0") + F.col("bid_1") - 10_000, F.col("size"), ["bid_0", "bid_1"], hour, 1_000).collect()}
    assert got[1].state_id == 2 and got[1].magnitude == 600 and got[1].fees == 70
    assert abs(got[1].excess - (6 - 70 / 20 - 2)) < 1e-12
    assert [got[g].tradeable for g in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[2].excess < 0 and got[3].excess > 0 and got[4].end_us is None
