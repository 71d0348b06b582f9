"""Operators on bars, returns and corpora of paths."""
