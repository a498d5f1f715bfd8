"""Operators for training data made from conversations; nothing else in the library imports them."""
