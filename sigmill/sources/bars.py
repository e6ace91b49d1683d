"""Bars, funding and supplemental series: readers, normalisation, writer, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

#: Columns of a raw bar file, by position.
RAW_BARS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume", "ignore")
RAW_FUNDING = ("calc_time", "funding_interval_hours", "last_funding_rate")
LAYOUT = ("market", "dataset", "symbol", "interval", "year", "month")
# Named lists of instruments.
PRESETS = {
    "default": "BTCUSDT ETHUSDT",
    "um_liquid_30": "BTCUSDT ETHUSDT SOLUSDT BNBUSDT XRPUSDT DOGEUSDT ADAUSDT AVAXUSDT LINKUSDT DOTUSDT TRXUSDT LTCUSDT BCHUSDT UNIUSDT NEARUSDT AAVEUSDT APTUSDT ARBUSDT OPUSDT SUIUSDT FILUSDT ATOMUSDT ETCUSDT INJUSDT TIAUSDT WIFUSDT PEPEUSDT ORDIUSDT SEIUSDT 1000SHIBUSDT",
}


def interval_ms(text: str) -> int:
    """5m, 1h, 1d and the like in milliseconds."""
    unit = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}.get(text[-1:])
    if unit is None or not text[:-1].isdigit() or int(text[:-1]) < 1:
        raise ValueError(f"unsupported interval: {text!r}")
    return int(text[:-1]) * unit


def bars_per_year(interval: str) -> float:
    return 365 * 86_400_000 / interval_ms(interval)


def epoch_ms(t: Column) -> Column:
    """Milliseconds from milliseconds or microseconds."""
    t = t.try_cast("long")
    return F.when(t >= 10**15, F.floor(t / 1000)).otherwise(t).cast("long")


def date_ms(text: Column) -> Column:
    """Milliseconds of an ISO date or time, read as UTC where it names no zone."""
    return F.unix_millis(F.to_timestamp(text))


def as_double(x: Column) -> Column:
    return fr.finite(x.try_cast("double"))


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Positional columns to typed bars; header rows and rows without a time go.

    data_quality_degraded marks rows in which a price could not be read.
    """
    named = raw.toDF(*RAW_BARS[: len(raw.columns)])
    have = set(named.columns)
    out = {c: epoch_ms(F.col(c)) for c in ("open_time", "close_time") if c in have}
    out |= {c: as_double(F.col(c)) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume") if c in have}
    if "trade_count" in have:
        out["trade_count"] = F.col("trade_count").try_cast("double").cast("long")
    df = named.select(*[c.alias(n) for n, c in out.items()]).where("open_time is not null")
    bad = fr.any_of([F.col(c).isNull() for c in ("open", "high", "low", "close")])
    return with_defaults(df.withColumn("data_quality_degraded", bad))


def normalize_funding(raw: DataFrame) -> DataFrame:
    named = raw.toDF(*RAW_FUNDING[: len(raw.columns)])
    return named.select(epoch_ms(F.col("calc_time")).alias("calc_time"), F.col("funding_interval_hours").try_cast("double").cast("long").alias("funding_interval_hours"), as_double(F.col("last_funding_rate")).alias("last_funding_rate")).where("calc_time is not null")


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill in what a plain OHLCV file lacks: turnover from the close, takers half, no trade counts."""
    quote = F.col("quote_volume") if "quote_volume" in df.columns else F.col("volume") * F.col("close")
    more = {
        "quote_volume": quote,
        "taker_buy_volume": F.col("volume") * 0.5,
        "taker_buy_quote_volume": quote * 0.5,
        "trade_count": F.lit(0).cast("long"),
        "data_quality_degraded": F.lit(False),
    }
    return df.withColumns({k: v for k, v in more.items() if k not in df.columns})


def first_per_time(df: DataFrame, keys=fr.KEYS, time: str = fr.TIME, *, last: bool = False) -> DataFrame:
    """One row for each time: the first (or last) in the order of all other columns."""
    rest = [F.col(c) for c in sorted(df.columns) if c not in (*keys, time)]
    order = [c.desc_nulls_last() if last else c.asc_nulls_last() for c in rest]
    w = Window.partitionBy(*keys, time).orderBy(*order) if order else Window.partitionBy(*keys, time).orderBy(time)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tail(df: DataFrame, n: int, keys=fr.KEYS, time: str = fr.TIME) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def scan_bars(spark: SparkSession, path: str, *, market: str | None = None, symbols: list[str] | None = None, interval: str | None = None, start_ms: int | None = None, end_ms: int | None = None, rows: int | None = None) -> DataFrame:
    """Bars of a partitioned store; partition and time filters reach the scan."""
    df = spark.read.parquet(path)
    if "dataset" in df.columns:
        df = df.where("dataset = 'klines'")
    for column, value in (("market", market), ("interval", interval)):
        if value is not None and column in df.columns:
            df = df.where(F.col(column) == value)
    if symbols:
        df = df.where(F.col("symbol").isin([s.strip().upper() for s in symbols]))
    df = df.where(F.col(fr.TIME) >= start_ms) if start_ms is not None else df
    df = df.where(F.col(fr.TIME) <= end_ms) if end_ms is not None else df
    df = first_per_time(with_defaults(df), keys=tuple(c for c in ("symbol", "market", "interval") if c in df.columns))
    return tail(df, rows) if rows is not None else df


def scan_dataset(spark: SparkSession, path: str, dataset: str, *, time: str = "open_time", symbol: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("dataset") == dataset)
    df = df.where(F.col("symbol") == symbol) if symbol else df
    return first_per_time(df, time=time, last=True)


def scan_funding(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    return scan_dataset(spark, path, "fundingRate", time="calc_time", symbol=symbol)


def write_bars(df: DataFrame, path: str, *, market: str, dataset: str, interval: str, time: str = fr.TIME) -> None:
    """Hive layout, one sorted file for each (symbol, month), times unique."""
    at = F.timestamp_millis(F.col(time))
    out = first_per_time(df, time=time).withColumns({"market": F.lit(market), "dataset": F.lit(dataset), "interval": F.lit(interval), "year": F.year(at), "month": F.lpad(F.month(at).cast("string"), 2, "0")})
    out.repartition("symbol", "year", "month").sortWithinPartitions("symbol", "year", "month", time).write.partitionBy(*LAYOUT).mode("append").parquet(path)


def extent(df: DataFrame, time: str = fr.TIME, keys=fr.KEYS) -> DataFrame:
    """First and last time and rows of each key, with a hash that ignores order."""
    return df.groupBy(*keys).agg(F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.count(F.lit(1)).alias("rows"), frame_hash(df).alias("content_hash"))


def frame_hash(df: DataFrame) -> Column:
    """Of all rows in any order: sums of two row hashes (repeated rows count) and the number of rows."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws("|", total(1), total(2), F.count(F.lit(1)).cast("string")), 256)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """year, month rows from one ISO date's month to another's, both included."""
    days = F.sequence(F.trunc(F.to_date(F.lit(first)), "month"), F.trunc(F.to_date(F.lit(last)), "month"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(days).alias("d")).select(F.year("d").alias("year"), F.month("d").alias("month"))


def universe(spark: SparkSession, preset: str = "default", symbols: list[str] | None = None) -> DataFrame:
    """symbol rows of a preset, or of given names: upper case, each once, in order."""
    if symbols is None and preset not in PRESETS:
        raise ValueError(f"unknown universe preset {preset!r}; there are {', '.join(sorted(PRESETS))}")
    names = PRESETS[preset].split() if symbols is None else symbols
    clean = dict.fromkeys(s.strip().upper() for s in names if s.strip())
    if not clean:
        raise ValueError("at least one symbol is required")
    return spark.createDataFrame([(s,) for s in clean], "symbol string")


def zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of zip archives that hold headerless or headed CSV files."""
    import io
    import zipfile

    import pandas as pd

    columns = ", ".join(f"{c} string" for c in RAW_BARS)

    def read(batches):
        for b in batches:
            for raw in b["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        df = pd.read_csv(z.open(name), header=None, dtype=str, names=list(RAW_BARS))
                        yield df.astype(object).where(df.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return normalize_bars(files.select("content").mapInPandas(read, columns))


def bars_from_ticks(ticks: DataFrame, *, key: str, time: str, price: str, tie: str, unit: str = "hour", size: str | None = None) -> DataFrame:
    """Ticks to bars: first and last price by (time, tie), extremes, count and sum."""
    at = F.date_trunc(unit, F.col(time))
    order = F.struct(time, tie)
    amount = F.col(size) if size else F.lit(1.0)
    return (
        ticks.groupBy(F.col(key).alias("symbol"), F.unix_millis(at).alias("open_time"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
            F.sum(amount).cast("double").alias("volume"), F.sum(F.col(price) * amount).alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"),
        )
    )
