"""Table declarations, filters and the query builder."""
