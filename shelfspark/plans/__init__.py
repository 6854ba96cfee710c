"""The registered queries over the reference's operators."""

from . import catalog_queries, file_queries, ingest_queries, retrieval_queries, rows_queries, store_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
