"""Preparation of training text: ten operators and the queries that apply them."""
