"""Registered queries, grouped by subject, each beside the SQL it must equal."""
