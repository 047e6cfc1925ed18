"""Operators for preparing text and candidate data at scale."""
