"""Scoring while results arrive."""
