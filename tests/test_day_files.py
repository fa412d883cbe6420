from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidemill.sources import day_files, market

NY = ZoneInfo("America/New_York")
SCHEMA = "timestamp timestamp, open double, high double, low double, close double, volume long"


def bars(spark, days, first="2024-01-02"):
    at = F.to_timestamp(F.concat(F.date_add(F.to_date(F.lit(first)), (F.col("id") / 390).cast("int")).cast("string"), F.lit(" 09:30:00 America/New_York"))) + F.make_dt_interval(mins=F.col("id") % 390)
    price = F.lit(100.0) + F.col("id") % 4 * 0.25
    return spark.range(390 * days).select(at.alias("timestamp"), price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), F.col("id").alias("volume"))


def test_a_window_reads_its_days_alone(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    whole = bars(spark, 12)
    day_files.write_days(whole, path)
    df = day_files.read_days(spark, path, SCHEMA)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, whole.collect()))
    assert df.rdd.getNumPartitions() == 12
    a, b = datetime(2024, 1, 5, 9, 30, tzinfo=NY), datetime(2024, 1, 6, 16, tzinfo=NY)
    cut = df.where((F.col("timestamp") >= F.lit(a)) & (F.col("timestamp") < F.lit(b)))
    assert cut.count() == 780 and cut.rdd.getNumPartitions() == 4  # the two days, and one on either side for the zone
    assert df.where(F.col("timestamp") > F.lit(datetime(2030, 1, 1, tzinfo=NY))).count() == 0
    source = market.TableSource(df, df.limit(0), df.limit(0), df.limit(0))
    assert source.bars(a, datetime(2024, 1, 5, 16, tzinfo=NY)).count() == 390


def test_days_arrive_once(spark, tmp_path):
    path, out = f"file://{tmp_path}/days", []
    day_files.write_days(bars(spark, 2), path)
    stream = lambda: day_files.read_days(spark, path, SCHEMA, stream=True)
    write = lambda: stream().writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(90)
    for more in (0, 3):
        if more:
            day_files.write_days(bars(spark, more, "2024-01-08"), path)
        assert write() is not False
        out.append(spark.read.parquet(f"file://{tmp_path}/out").count())
    assert out == [780, 780 + 1170]
