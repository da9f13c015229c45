"""DataFrame -> DataFrame operators: schema, joins, aggregates, profiles, windows, sampling."""
