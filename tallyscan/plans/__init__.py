"""Whole jobs, the tables they are tried on, and the registered queries."""
