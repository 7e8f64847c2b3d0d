"""Whole queries: search, fetch and video pages."""
