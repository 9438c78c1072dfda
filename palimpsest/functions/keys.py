"""Order and prefix arithmetic on keys (unsigned bytes, shorter first on a tie)."""

from __future__ import annotations


def as_bytes(x: bytes | bytearray | str | None) -> bytes | None:
    return x.encode() if isinstance(x, str) else None if x is None else bytes(x)


def successor(prefix: bytes) -> bytes | None:
    """The least key above every key with this prefix; None if there is none (all bytes 0xFF)."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def text_successor(prefix: str) -> str | None:
    """The same for string columns: the last code point that can be raised is raised (surrogates are skipped)."""
    for i in range(len(prefix) - 1, -1, -1):
        if (c := ord(prefix[i])) < 0x10FFFF:
            return prefix[:i] + chr(0xE000 if c == 0xD7FF else c + 1)
    return None


def prefix_range(prefix: bytes | str) -> tuple:
    """[start, end) that holds exactly the keys with this prefix. A range reaches the Parquet scan, a binary startswith() does not."""
    if not prefix:
        raise ValueError("the prefix is empty")
    return prefix, (text_successor if isinstance(prefix, str) else successor)(prefix)
