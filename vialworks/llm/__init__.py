"""Operators for text of large corpora; nothing else in the library imports this subpackage."""
