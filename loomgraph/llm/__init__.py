"""Operators for training corpora.  Optional: nothing in the rest of the library imports this."""
