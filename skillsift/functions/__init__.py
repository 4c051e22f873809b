"""Scalar Column expressions: text cleaning and tokens, dates, the similarity ratio."""
