"""DataFrame operators: contracts, joins, ranks, residuals, scores, summaries, ensembles, splits, gates."""
