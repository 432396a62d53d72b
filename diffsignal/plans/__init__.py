"""Plans: index maintenance, review, bench, and the catalog of queries with their SQL twins."""
