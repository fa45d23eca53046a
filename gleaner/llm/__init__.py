"""Operators for preparing training corpora; nothing else in this package imports them."""
