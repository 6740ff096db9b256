"""DataFrame operators: filters, joins, aggregates, windows, ordering, row assembly, outcomes, similarity."""
