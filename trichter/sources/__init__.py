"""The three funnel tables: schemas, readers, writers and the mapping from the star-schema test data."""
