"""Composed jobs over whole tables."""
