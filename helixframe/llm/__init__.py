"""Operators for preparing language-model training corpora (documents, pages, embeddings)."""
