"""Relational operators over documents, chunks and claims."""
