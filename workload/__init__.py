"""Queries over the driver's tables that exercise every operator, each with DuckDB SQL."""
