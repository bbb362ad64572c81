"""Queries over the tables, each with the DuckDB SQL it must agree with where there is one."""
