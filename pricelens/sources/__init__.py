"""Readers for the input tables and the stand-in views built on them."""
