"""Operators on record tables: search, filters, validation, quantisation, routing and evaluation."""
