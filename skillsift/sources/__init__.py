"""Readers: landed JSON pages and details, catalog tables, bronze partitions, serving tables."""
