"""Trichter: marketing-funnel and booking analytics as Spark jobs.

``sources``    reads and writes the three funnel tables,
``functions``  holds column helpers,
``operators``  holds reusable DataFrame-to-DataFrame steps,
``plans``      holds the named analyses and their catalogue.
"""

from trichter.plans.catalogue import ANALYSES, Params, answer, run_catalogue, query
from trichter.plans.ingest import ingest
from trichter.session import build_session, durable
from trichter.sources.colocated import load_colocated, publish_colocated
from trichter.sources.tables import FunnelTables, load_tables, publish_tables, replace_months, write_tables

__all__ = [
    "ANALYSES",
    "FunnelTables",
    "Params",
    "answer",
    "build_session",
    "durable",
    "ingest",
    "load_colocated",
    "load_tables",
    "publish_colocated",
    "publish_tables",
    "query",
    "replace_months",
    "run_catalogue",
    "write_tables",
]
