import numpy as np
import pytest
from data import frame, one, walk
from pyspark.sql import functions as F
from tidemark import operators as O
from tidemark.functions.kernels import scan
from tidemark.streaming.feeds import STREAMED, stream_feeds
from tidemark.streaming.incremental import stream_bars, stream_ema

SCHEMA = "symbol string, ts timestamp, close double"


def test_scan_goes_on_over_batches(spark, tmp_path):
    bars = frame(spark, a=walk(90), b=walk(90, seed=2)).select("symbol", F.timestamp_seconds(F.col("ts") * 60).alias("ts"), "close")
    for k in range(3):
        bars.where((F.minute("ts") + 60 * F.hour("ts")).between(30 * k, 30 * k + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream_ema(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), {"slow": 0.1, "fast": 0.5}).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    for s, seed in (("a", 5), ("b", 2)):
        close = walk(90, seed=seed)["close"].to_numpy()
        assert np.allclose(one(got, s, "fast"), scan(close, 0.5)) and np.allclose(one(got, s, "slow"), scan(close, 0.1))


def test_bars_after_the_watermark(spark, tmp_path):
    ticks = spark.range(200).select(F.lit("a").alias("s"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("p"), "id")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    query = stream_bars(stream, "s", "ts", "p", "id").writeStream.format("memory").queryName("bars_out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("bars_out").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(0.0, 6.0, 0.0, 59 % 7, 60.0), (60 % 7, 6.0, 0.0, 119 % 7, 60.0), (120 % 7, 6.0, 0.0, 179 % 7, 60.0)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def stream_batches(spark, tmp_path, batches, **how):
    """What stream_feeds gives for parquet files that arrive one batch after the other."""
    for bars in batches:
        bars.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))
        stream = stream.withWatermark("ts", "1 minute") if how.get("silence") else stream
        query = stream_feeds(stream, list(STREAMED), **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_feeds_equal_the_batch(spark, rocks, tmp_path):
    """RSI, MACD, SuperTrend and the others, fed in batches of uneven size with a bar that comes too late."""
    bars = frame(spark, a=walk(90), b=walk(90, seed=2)).withColumn("ts", F.timestamp_seconds(F.col("ts") * 60)).select("symbol", "ts", "open", "high", "low", "close", "volume").cache()
    minute = F.unix_timestamp("ts") / 60
    cuts = [0, 1, 40, 41, 90]
    batches = [bars.where(minute.between(a, b - 1)) for a, b in zip(cuts, cuts[1:])]
    batches[-1] = batches[-1].unionByName(bars.where((F.col("symbol") == "a") & (minute == 5)))
    got = stream_batches(spark, tmp_path, batches)
    want = O.with_feeds(bars, [f for f in O.feed_ids() if O.FEEDS[f][0] in STREAMED])
    names = [n for _, _, lines in STREAMED.values() for n in lines]
    assert got.count() == 180
    for s in "ab":
        assert np.allclose(one(got, s, *names), one(want, s, *names), rtol=1e-9)


def test_silent_series_begin_anew(spark, rocks, tmp_path):
    bars = frame(spark, a=walk(60), b=walk(60, seed=2)).withColumn("ts", F.timestamp_seconds(F.col("ts") * 60)).select("symbol", "ts", "open", "high", "low", "close", "volume").cache()
    minute = F.unix_timestamp("ts") / 60
    # a is silent from 10 to 50 while b goes on, so its state goes.
    batches = [bars.where(minute < 10), bars.where("symbol = 'b'").where(minute.between(10, 39)), bars.where("symbol = 'b'").where(minute.between(40, 45)), bars.where(minute >= 50)]
    got = stream_batches(spark, tmp_path, batches, silence=600)
    alone = O.with_feeds(bars.where("symbol = 'a'").where(minute >= 50), ["IND_EMA"])
    assert np.allclose(one(got.where(minute >= 50), "a", "ind_ema"), one(alone, "a", "ind_ema"))
