"""Integers out of JSON payloads."""

from __future__ import annotations


def json_int(payload: str, key: str) -> str:
    """Member ``key`` as BIGINT, null where it is missing or not an integer."""
    return f"try_cast(get_json_object({payload}, '$.{key}') as bigint)"
