"""Operators for preparing language-model training data (one module per operator).

Nothing else in the library imports this package; ``queries.py`` holds the registered
queries and ``/corpus_pipeline.py`` chains five of the operators.
"""
