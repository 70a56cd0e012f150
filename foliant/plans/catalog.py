"""Registers all queries by importing the modules that hold them."""

from foliant.plans import chunk_queries, layout_queries, markdown_queries, model_queries, scan_queries, sheet_queries, text_queries  # noqa: F401
