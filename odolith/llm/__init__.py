"""Operators of a training-data pipeline over the tables documents, labels, embeddings, benchmark and conversations.

Nothing else in the library imports this subpackage.
"""
