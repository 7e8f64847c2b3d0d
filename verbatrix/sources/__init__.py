"""Readers of web pages, result listings and video records held in tables."""
