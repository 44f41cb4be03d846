"""Whole jobs: preparing tables, fitting the cascade, training and evaluating."""
