"""Declared schemas of every input and output table; nothing is inferred."""

from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in columns.items()])


PRICES = {"open": DoubleType, "high": DoubleType, "low": DoubleType, "close": DoubleType}
RAW_BARS_CSV = _struct(ts=TimestampType, **PRICES, volume=LongType, ntrades=LongType, vwap=DoubleType)
RAW_BARS = _struct(sym=StringType, ts=TimestampNTZType, **PRICES, volume=LongType, ntrades=LongType, vwap=DoubleType, seq=LongType)
DAILY_CSV = _struct(date=DateType, **PRICES, volume=LongType)
FACTORS = _struct(date=DateType, mkt_rf=DoubleType, smb=DoubleType, hml=DoubleType, wml=DoubleType, rf=DoubleType)
PREDS_CSV = _struct(date=DateType, sym=StringType, bkt=StringType, pred=DoubleType)
