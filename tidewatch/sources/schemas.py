"""Declared schemas; no source is ever inferred."""

from pyspark.sql import types as T

from tidewatch import constants as K

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("bytes_sent", T.DoubleType()),
    T.StructField("bytes_recv", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("log_level", T.StringType()),
    T.StructField("message", T.StringType()),
])


def _nsl_type(name: str) -> T.DataType:
    if name in K.NSL_STRING_COLUMNS:
        return T.StringType()
    return T.DoubleType() if name.endswith("_rate") else T.LongType()


NSL_SCHEMA = T.StructType([T.StructField(name, _nsl_type(name)) for name in K.NSL_COLUMNS])


def unsw_schema(header: list[str]) -> T.StructType:
    """Schema for a headered flow file: known columns typed, the rest kept as text."""
    types = {name: T.LongType() for name in K.UNSW_LONG_COLUMNS}
    types.update({name: T.DoubleType() for name in K.UNSW_DOUBLE_COLUMNS})
    return T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header])


UNSW_SCHEMA = unsw_schema(K.UNSW_STRING_COLUMNS + K.UNSW_LONG_COLUMNS + K.UNSW_DOUBLE_COLUMNS)
