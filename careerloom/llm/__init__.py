"""Operators of a training-data pipeline.  Nothing else in careerloom imports them."""
