"""Column functions: distances, hashes, text features, codecs, formats and synthetic vectors."""
