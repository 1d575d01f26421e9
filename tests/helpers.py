"""Small literal tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from trichter.sources import schemas


def day(text: str) -> date:
    return date.fromisoformat(text)


def spend_table(spark, rows):
    """Rows of (hotel_id, day, impressions, clicks, leads, cost)."""
    data = [
        ("c", hotel, day(d) if d else None, "Search", impressions, clicks, leads, Decimal(str(cost)))
        for hotel, d, impressions, clicks, leads, cost in rows
    ]
    return spark.createDataFrame(data, schemas.SPEND)


def bookings_table(spark, rows):
    """Rows of (booking_id, hotel_id, day, revenue)."""
    data = [(b, hotel, day(d) if d else None, "City", Decimal(str(revenue))) for b, hotel, d, revenue in rows]
    return spark.createDataFrame(data, schemas.CONVERSIONS)


def entity_table(spark, ids):
    return spark.createDataFrame([(i, "Land", "Region", "4 Star") for i in ids], schemas.ENTITIES)


def months(count: int, first: str = "2024-01-01") -> list[str]:
    start = day(first)
    return [date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1).isoformat() for i in range(count)]
