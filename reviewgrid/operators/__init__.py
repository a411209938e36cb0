"""Table-to-table operators of the review engine."""
