"""The engine: a catalog of collections over published log batches, and the registered queries."""
