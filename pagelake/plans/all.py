"""Import every query module so the registry is complete."""

from . import app_tables, blocks_q, classify_q, crawl_q, detectors_q, export_q, scrape_q, stored_q, streams_q, url_links, versions_q  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
