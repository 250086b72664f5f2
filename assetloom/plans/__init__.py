"""Query catalogue: operators applied to the given tables, with SQL twins."""
