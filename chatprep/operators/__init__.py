"""DataFrame -> DataFrame operators (windows, joins, aggregates)."""
