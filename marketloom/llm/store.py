"""Intermediate tables of the corpus operators: those of the library."""

from marketloom.store import discard, materialise, shared_dir

__all__ = ["discard", "materialise", "shared_dir"]
