"""Operators for building language-model training data from very large document tables.

Each module is one operator with its own general interface; ``queries`` registers one thin query per operator.
"""
