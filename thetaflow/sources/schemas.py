"""Declared schemas of the two market-data sources and of derived tables."""

from pyspark.sql import types as T

SECURITY_PRICE = T.StructType([
    T.StructField("securityid", T.IntegerType()),
    T.StructField("date", T.DateType()),
    T.StructField("closeprice", T.DoubleType()),
    T.StructField("bidlow", T.DoubleType()),
    T.StructField("askhigh", T.DoubleType()),
])

OPTION_PRICE = T.StructType([
    T.StructField("securityid", T.IntegerType()),
    T.StructField("callput", T.StringType()),
    T.StructField("strike", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("expiration", T.DateType()),
    T.StructField("bestbid", T.DoubleType()),
    T.StructField("bestoffer", T.DoubleType()),
])
