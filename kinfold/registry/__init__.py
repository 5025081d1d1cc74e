"""Queries over the given tables, one or more per operator, with their oracle SQL."""

from __future__ import annotations

from importlib import import_module

_TOPICS = ("text", "groups", "vectors", "retrieval", "learning", "storage")


def _merged(name: str) -> dict:
    merged = {}
    for topic in _TOPICS:
        merged |= getattr(import_module(f"kinfold.registry.{topic}"), name)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
