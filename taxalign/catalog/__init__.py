"""Registered queries over the driver's tables, and the same queries in DuckDB SQL."""
