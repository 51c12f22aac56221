"""DataFrame operators: audits, joins, versioned results, run journals, pipelines and closures."""
