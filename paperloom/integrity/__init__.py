"""Manifests, verification, atomic replacement and recovery of an index."""
