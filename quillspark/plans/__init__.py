"""Registered queries, grouped by subject, with the SQL that gives the same rows."""
