"""DataFrame operators: selection, ranking, joins in time, audits, evaluation."""
