"""Registered queries over the shared test tables, with matching SQL."""
