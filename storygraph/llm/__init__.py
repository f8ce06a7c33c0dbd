"""Operators for preparing language-model training data; nothing else in storygraph imports them."""
