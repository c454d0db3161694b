"""Queries over the test tables, each with DuckDB SQL where SQL can express it."""
