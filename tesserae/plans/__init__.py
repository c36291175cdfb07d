"""The query catalogue: every query with the SQL that states its result."""
