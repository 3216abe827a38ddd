"""ASCII-lowered words of UTF-8 bytes: runs of digits, letters and non-ASCII bytes."""

from __future__ import annotations

#: bytes.translate table: A-Z become a-z; digits, a-z and every byte of a non-ASCII character stay; the rest is a space.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(NORMAL).split()
