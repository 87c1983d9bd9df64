"""CRC-32 as a DuckDB expression."""

from __future__ import annotations


def _entry(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


#: What a half byte adds, by the usual reversed polynomial.
_HALVES = [_entry(i) for i in range(16)]


def ascii_codes(text: str) -> str:
    """The codes of the characters of an ASCII text expression, as a list."""
    return f"list_transform(string_split({text}, ''), lambda x: unicode(x)::bigint)"


def crc32(codes: str) -> str:
    """The unsigned checksum of a list expression of byte values."""
    table = "[" + ", ".join(f"{v}::bigint" for v in _HALVES) + "]"
    half = f"xor(%s >> 4, {table}[(xor(%s, %s) & 15) + 1])"
    low = half % ("c", "c", "b")
    step = half % (low, low, "(b >> 4)")
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda c, b: {step}), 4294967295::bigint)"
