"""Queries: one plan per operator over the driver's tables, each with DuckDB SQL where one exists."""
