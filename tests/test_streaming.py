from datetime import datetime, timedelta

from clinflow.streaming import windows


def test_windows_and_endpoints(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(hours=h), "e" if h % 2 else "d", float(h)) for h in range(48)]
    schema = "stay_id long, event_time timestamp, evidence string, value double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 10)
    windows.write_parquet(windows.feature_windows(stream, "event_time", "stay_id", "value"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() > 20 and got.where("n > 6").count() == 0
    stays = spark.createDataFrame([(1, t0 + timedelta(hours=12), t0 + timedelta(hours=24))], "stay_id long, landmark_time timestamp, horizon_end timestamp")
    windows.write_parquet(windows.first_endpoint(stream, stays, "event_time", "stay_id", ["e"]), str(tmp_path / "hits"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 1
