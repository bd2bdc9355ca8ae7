"""Registered queries: every operator on the driver tables, with SQL that tells the same rows."""
