"""Query registry: brokerage-shaped views over the star-schema test tables, one named query per
operator, and the SQL that an independent engine runs for comparison."""
