"""Relational operators: selection, filling, history, fits, scores, search."""
