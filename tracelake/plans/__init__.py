"""Registered queries: each applies library operators to whole tables, beside its SQL twin."""
