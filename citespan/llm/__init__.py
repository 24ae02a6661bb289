"""Operators for preparing language-model training data.  Nothing else in citespan imports this."""
