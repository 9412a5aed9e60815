"""Registered queries: operators applied to the views, and the same in SQL."""
