"""Table catalogue: role schemas, file loading, and the star-schema test mapping."""
