"""The change log: one row per put or delete; the newest row of a key decides."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, DELETE = 0, 1

VREF = T.StructType([T.StructField("gen", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("len", T.IntegerType())])

#: `seq` is unique and grows with every write, so recency is a sortable column and never depends on file order.
CHANGE_LOG = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.ByteType(), False),
    T.StructField("value", T.BinaryType()),
])

RUN = T.StructType([*CHANGE_LOG.fields, T.StructField("vref", VREF)])

VALUES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), False),
])
