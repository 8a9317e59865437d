"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries`` in
``tessera.llm.registry`` lists what it offers.
"""
