"""Training-data operators over documents and embeddings.

Nothing outside this folder imports it.  ``queries.py`` holds the registered
queries; every other module is one operator with its own general interface.
"""
