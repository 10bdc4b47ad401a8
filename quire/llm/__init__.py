"""Operators for preparing language-model training corpora (nothing else in quire imports them)."""
