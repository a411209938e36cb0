"""Readers: base tables, fixture views, and the review-domain sources S1-S6."""
