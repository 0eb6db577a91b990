"""Operators for preparing large language-model training corpora.

Self-contained: nothing else in the library imports this subpackage.
"""
