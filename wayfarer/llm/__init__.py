"""Operators that prepare text corpora and vectors for model training.

Nothing outside this folder imports it. Executors import the package by name, so a
cluster needs the repository on its Python path (``--py-files`` or an image).
"""
