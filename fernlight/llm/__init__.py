"""Operators for preparing language-model training data, each a function from DataFrame to DataFrame.

Nothing else in the library imports this subpackage.
"""
