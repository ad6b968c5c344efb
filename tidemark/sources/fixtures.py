"""Small literal tables: the data catalog's seed, requirements, strategy texts, tables in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.vocabulary import CATALOG_SEED

CATALOG = "asset_class string, symbol string, granularity string, has_l2_book boolean, has_order_flow boolean, start_year int"
REQUIREMENT = "asset_class string, symbol string, required_granularity string, requires_l2_book boolean, requires_order_flow boolean, start_year int"

REQUIREMENTS = [
    ("Crypto", "BTCUSDT", "1h", False, False, 2021), ("Crypto", "ethusdt", "tick", True, True, None), ("Equity", "ADAUSDT", "1d", True, False, None),
    ("Crypto", "DOGEUSDT", "1m", False, True, None), ("Crypto", "SOLUSDT", "5m", False, False, None), ("Equity", "QQQ", "1m", False, False, None),
    ("Crypto", "ADAUSDT", "1h", False, False, 2019), ("Crypto", "BTCUSDT", "tick", True, False, 2020),
]
TEXTS = [
    (1, "Enter long when price crosses above the volume weighted average price on a 15-minute chart; exit when it falls below the VWAP."),
    (2, "Band breakout of the Bollinger Bands with RSI confirmation, daily data from Binance. Stop loss at 2 ATR."),
    (3, "Buy when the exponential moving average breaks below the lower band. Take-profit when it crosses above."),
    (4, "Needs tick data from Bloomberg and an LSTM on a GPU; reacts to FOMC and interest rate news in 1 hour."),
    (5, "Price reversion in quiet markets, no indicator at all."),
    (6, "MACD and stochastic RSI cross, 4 hrs bars, order book data from Kraken, market maker and dividend effects."),
    (7, "Momentum with relative strength index, exponential moving averages and Williams %R; trailing stop."),
    (8, ""),
]
MATH = [(1, "Let σ ≤ 2 and α ± 1."), (2, r"Use $\sigma + x$ and \(y\) with \beta."), (3, "plain"), (4, r"$z$ only"), (5, "Σ × Δ")]
TABLES = {
    "fit": [["Param", "Value", "Bounds"], ["fast", "10", "[1, 100]"], ["k", "2.5", "0.5, 4"]],
    "bad": [["Param", "Value", "Bounds"], ["fast", "ten", "[1, 100]"], ["slow", "30", "[5, 1]"], ["", "1", "x"], ["cut", "3"]],
    "orphan": [["Name", "Price"], ["a", "1"]],
}


def catalog_seed(spark: SparkSession) -> DataFrame:
    """The catalog's rows before anything else was registered."""
    return spark.createDataFrame([(c, s, g, deep, deep, year) for c, symbols, grains, deep, year in CATALOG_SEED for s in symbols for g in grains], CATALOG)


def write_catalog(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog at a path, seeded first if there is none; any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        write_catalog(catalog_seed(spark), path)
    return spark.read.schema(CATALOG).parquet(path)


def granularities(catalog: DataFrame) -> DataFrame:
    return catalog.select("granularity").distinct()


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, REQUIREMENT)


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "id int, text string")


def maths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MATH, "id int, text string")


def cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, r, c, x) for t, rows in TABLES.items() for r, row in enumerate(rows) for c, x in enumerate(row)], "table_id string, row int, col int, text string")


def values(rows: list[tuple]) -> str:
    """Rows as the VALUES of a SQL statement."""
    say = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)
