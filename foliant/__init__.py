"""Foliant: a PySpark-native document analytics engine.

Documents are scanned into normalised DataFrames (blocks, inlines, cells, spans,
warnings, chunks) and every analysis step is a DataFrame transform over them.
"""
