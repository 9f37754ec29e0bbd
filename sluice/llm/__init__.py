"""Operators for language-model training data.

Each module holds one operator as a DataFrame-in, DataFrame-out function;
``queries`` holds the thin registered queries.
"""
