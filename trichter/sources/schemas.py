"""Declared schemas. Money is decimal(18,2) so that sums can be exact."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

SPEND = T.StructType(
    [
        T.StructField("campaign_id", T.StringType()),
        T.StructField("hotel_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("campaign_type", T.StringType()),
        T.StructField("impressions", T.LongType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("leads", T.LongType()),
        T.StructField("cost", MONEY),
    ]
)

CONVERSIONS = T.StructType(
    [
        T.StructField("booking_id", T.StringType()),
        T.StructField("hotel_id", T.StringType()),
        T.StructField("booking_date", T.DateType()),
        T.StructField("travel_type", T.StringType()),
        T.StructField("revenue", MONEY),
    ]
)

ENTITIES = T.StructType(
    [
        T.StructField("hotel_id", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("hotel_category", T.StringType()),
    ]
)

ATTRIBUTES = ("country", "region", "hotel_category")
