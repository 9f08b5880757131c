"""Operators that prepare text for model training; nothing outside this folder imports them."""
