"""Named queries over the test tables, and DuckDB SQL that gives the same rows."""
