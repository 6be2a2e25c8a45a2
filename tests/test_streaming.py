import datetime as dt

from linkweave.streaming import arrivals


def test_arrivals_join_and_resume(spark, tmp_path):
    clean = spark.createDataFrame([("S1-1", "Alpha Foods", "12 Main St", "US")], "entity_id string, business_name string, business_address string, country string")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    day = dt.datetime(2025, 1, 1)
    first = [("S2-1", "alpha foods ltd", "12 Main Street", "US", day), ("S2-1", "alpha foods ltd", "12 Main Street", "US", day + dt.timedelta(days=9)), ("S2-2", None, None, "US", day)]
    spark.createDataFrame(first, arrivals.RECORD).write.mode("append").parquet(source)
    run = lambda: arrivals.append(arrivals.candidates(arrivals.once(arrivals.arriving(spark, source)), clean), out, mark).awaitTermination()
    run()
    pairs = lambda: sorted((r.s1, r.cand, r.k) for r in spark.read.parquet(out).collect())
    once = [("S1-1", "S2-1", k) for k in ("first_tok:alpha", "hnum:12", "nprefix:alph")]
    assert pairs() == once
    spark.createDataFrame([("S2-1", "alpha foods ltd", "12 Main Street", "US", day + dt.timedelta(days=20)), ("S2-3", "Alpha", "", "US", day)], arrivals.RECORD).write.mode("append").parquet(source)
    run()
    assert {r[1] for r in pairs()} == {"S2-1", "S2-3"} and len([r for r in pairs() if r[1] == "S2-1"]) == 3
