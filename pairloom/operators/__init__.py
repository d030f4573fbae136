"""DataFrame operators: pairs, records, statistics, scoring, ranking."""
