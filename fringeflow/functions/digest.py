"""Portable 32-bit digests: first eight hex digits of MD5 as a BIGINT."""

from __future__ import annotations


def digest(text: str) -> str:
    return f"cast(conv(substring(md5({text}), 1, 8), 16, 10) as bigint)"


def row_digest(*columns: str) -> str:
    """Digest of the rendered columns joined by ``|``; nulls are skipped."""
    rendered = ", ".join(f"cast({c} as string)" for c in columns)
    return digest(f"concat_ws('|', {rendered})")
