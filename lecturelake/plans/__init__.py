"""Whole jobs, fixture tables and the registered queries."""
