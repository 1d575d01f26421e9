"""Derive the three funnel tables and the question log from a TPC-H-like star schema.

Only integer and decimal arithmetic, so that any engine derives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trichter.sources.schemas import MONEY
from trichter.sources.tables import FunnelTables


# The columns read from each table. Declared, so that no footer is read to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "orders": "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_star(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def _nearest(value: Column) -> Column:
    """Nearest integer of a non-negative double; ``F.round`` would go through a decimal per row."""
    return F.floor(value + 0.5)


def _spend_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_star(spark, folder, "lineitem")
    quantity = F.col("l_quantity").cast("long")
    discount = _nearest(F.col("l_discount") * 100)
    tax = _nearest(F.col("l_tax") * 100)
    price_cents = _nearest(F.col("l_extendedprice"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_orderkey").cast("string").alias("campaign_id"),
        F.col("l_suppkey").cast("string").alias("hotel_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_returnflag").alias("campaign_type"),
        (100 * quantity).alias("impressions"),
        (quantity * discount).alias("clicks"),
        # One supplier in ten never gets a lead, which makes it a "gap" entity.
        F.when(F.col("l_suppkey") % 10 == 9, 0).otherwise(F.floor(quantity * discount * tax / 10)).alias("leads"),
        (price_cents.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("cost"),
    )


def _conversions(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_star(spark, folder, "orders")
    lines = read_star(spark, folder, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("booking_id"),
        F.col("l_suppkey").cast("string").alias("hotel_id"),
        F.col("o_orderdate").cast("date").alias("booking_date"),
        F.col("o_orderpriority").alias("travel_type"),
        F.col("l_extendedprice").cast(MONEY).alias("revenue"),
    )


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    supplier = read_star(spark, folder, "supplier")
    nation = read_star(spark, folder, "nation")
    region = read_star(spark, folder, "region")
    stars = (3 + F.col("s_suppkey") % 3).cast("string")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("hotel_id"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
            F.concat(stars, F.lit(" Star")).alias("hotel_category"),
        )
    )


def star_tables(spark: SparkSession, folder: str) -> FunnelTables:
    """The clean mapping."""
    spend = _spend_lines(spark, folder).drop("l_orderkey", "l_linenumber")
    return FunnelTables(spend, _conversions(spark, folder), _entities(spark, folder))


def untidy_star_tables(spark: SparkSession, folder: str) -> FunnelTables:
    """The same tables with untidy headers, text dates and planted faults, for cleaning and checks."""
    key = F.col("l_orderkey")
    clicks = F.when(key % 59 == 0, F.col("impressions") + 1).otherwise(F.col("clicks"))
    spend = _spend_lines(spark, folder).select(
        F.col("campaign_id").alias(" Campaign ID"),
        F.when(key % 103 == 0, F.lit(None))
        .when(key % 101 == 0, F.concat(F.lit("X"), F.col("hotel_id")))
        .otherwise(F.col("hotel_id"))
        .alias(" Hotel ID "),
        F.when(key % 97 == 0, F.lit("n/a")).otherwise(F.col("date").cast("string")).alias("Date"),
        F.when(F.col("l_linenumber") == 1, F.lit("\t city-trip "))
        .otherwise(F.col("campaign_type"))
        .alias("Campaign Type "),
        F.col("impressions").alias("Impressions"),
        clicks.alias("Clicks"),
        F.when(key % 61 == 0, clicks + 1).otherwise(F.col("leads")).alias("Leads"),
        F.when(key % 53 == 0, -F.col("cost")).otherwise(F.col("cost")).cast(MONEY).alias("Cost"),
    )
    conversions = _conversions(spark, folder).toDF(
        "Booking ID", "Hotel ID", "Booking Date", "TravelType", "Revenue"
    )
    entities = _entities(spark, folder).toDF("Hotel ID", "Country", "Region", "Hotel Category")
    return FunnelTables(spend, conversions, entities)


def faulty_star_tables(spark: SparkSession, folder: str) -> FunnelTables:
    """The untidy tables with faults planted in bookings and entities too."""
    untidy = untidy_star_tables(spark, folder)
    key = F.col("booking_id").cast("bigint")
    day = F.when(key % 3 == 0, F.date_format("booking_date", "dd.MM.yyyy")).otherwise(F.col("booking_date").cast("string"))
    conversions = _conversions(spark, folder).select(
        F.col("booking_id").alias("Booking ID"),
        F.when(key % 89 == 0, F.lit(None))
        .when(key % 83 == 0, F.concat(F.lit("X"), F.col("hotel_id")))
        .otherwise(F.col("hotel_id"))
        .alias(" Hotel ID"),
        F.when(key % 79 == 0, F.lit("soon")).otherwise(day).alias("Booking Date"),
        F.when(key % 2 == 0, F.concat(F.lit("\t"), F.lower("travel_type"), F.lit(" "))).otherwise(F.col("travel_type")).alias("TravelType"),
        F.when(key % 47 == 0, -F.col("revenue")).otherwise(F.col("revenue")).cast(MONEY).alias(" Revenue"),
    )
    entities = _entities(spark, folder).select(
        F.col("hotel_id").cast("bigint").alias("Hotel ID "),
        F.col("country").alias("Country"),
        F.col("region").alias(" Region"),
        F.concat(F.lit(" "), F.lower("hotel_category"), F.lit("\t")).alias("Hotel Category"),
    )
    return FunnelTables(untidy.spend, conversions, entities)


def dated_star_bookings(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings whose text dates are day first, but for some in ISO and some that are none."""
    key = F.col("booking_id").cast("bigint")
    day = F.when(key % 10 == 0, F.col("booking_date").cast("string")).otherwise(F.date_format("booking_date", "dd/MM/yyyy"))
    dated = F.when(key % 79 == 0, F.lit("soon")).otherwise(day)
    return _conversions(spark, folder).withColumn("booking_date", dated).withColumnRenamed("booking_date", "Booking Date")


def booking_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings as lines of CSV without a header, some with a field too many and some with too few."""
    key = F.col("booking_id").cast("bigint")
    line = F.concat_ws(",", "booking_id", "hotel_id", "booking_date", "travel_type", "revenue")
    return _conversions(spark, folder).select(
        F.when(key % 71 == 0, F.concat(line, F.lit(",x")))
        .when(key % 73 == 0, F.concat_ws(",", "booking_id", "hotel_id"))
        .otherwise(line)
        .alias("line")
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of a conversation log: ``conv_id``, ``turn``, ``text``."""
    log = read_star(spark, folder, "conversations")
    return log.where(F.col("role") == "user").select("conv_id", "turn", "text")
