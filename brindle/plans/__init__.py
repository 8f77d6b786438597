"""Composite query plans and the catalogue of registered queries."""
