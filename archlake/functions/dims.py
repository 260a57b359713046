"""The archive families and candle intervals, as small DataFrames to join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Family, offers monthly files, offers daily files, has intervals, is part of the research core.
FAMILIES = (
    ("klines", True, True, True, True),
    ("metrics", False, True, False, True),
    ("fundingRate", True, False, False, True),
    ("markPriceKlines", True, True, True, True),
    ("indexPriceKlines", True, True, True, True),
    ("premiumIndexKlines", True, True, True, True),
    ("aggTrades", True, True, False, False),
    ("trades", True, True, False, False),
    ("bookDepth", False, True, False, False),
    ("bookTicker", False, True, False, False),
)

# Interval codes with their length in minutes; None where the length isn't fixed.
INTERVAL_MINUTES = {
    "1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480, "12h": 720, "1d": 1440,
    "3d": None, "1w": None, "1mo": None,
}
DEFAULT_INTERVALS = ("1m", "5m", "1h", "4h", "1d")

CANDLE_FAMILIES = ("klines", "markPriceKlines", "indexPriceKlines", "premiumIndexKlines")

#: Which layer of sources wins for one timestamp: the later one.
LAYERS = {"monthly": 0, "daily": 1, "verified_repair": 2}

DAY_MS = 86_400_000


def interval_ms(code: str) -> int:
    minutes = INTERVAL_MINUTES.get(code)
    if minutes is None:
        raise ValueError(f"interval {code!r} has no fixed length")
    return minutes * 60_000


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "dataset string, monthly boolean, daily boolean, intervalled boolean, research_core boolean")


def intervals(spark: SparkSession) -> DataFrame:
    rows = [(c, None if m is None else m * 60_000, m is not None) for c, m in INTERVAL_MINUTES.items()]
    return spark.createDataFrame(rows, "interval string, ms long, fixed boolean")


def research_core(spark: SparkSession) -> DataFrame:
    """The families of the research core."""
    return catalog(spark).where("research_core").select("dataset")
