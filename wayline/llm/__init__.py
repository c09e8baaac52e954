"""Operators on texts and names for training data; nothing outside this folder imports it."""
