"""Relational operators over long-format signals and panels."""
