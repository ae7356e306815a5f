"""Streams of a compound file (the container of HWP): sectors, their chains and a directory, as the published format says."""

from __future__ import annotations

import struct
from collections.abc import Callable

# Marks of the compound file format.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
LAST_SECTOR = 0xFFFFFFFA
STORAGE, STREAM, ROOT = 1, 2, 5


def _chain(start: int, following: list[int]) -> list[int]:
    """Sectors from start on; a chain that comes back to itself or leaves the table is an error."""
    out: list[int] = []
    while start < LAST_SECTOR:
        if start >= len(following) or len(out) > len(following):
            raise ValueError("a broken chain of sectors")
        out.append(start)
        start = following[start]
    return out


def streams(data: bytes) -> dict[str, Callable[[], bytes]]:
    """Readers by path (parts joined by /): a stream is put together when it is read."""
    if len(data) < 512 or data[:8] != SIGNATURE:
        raise ValueError("not a compound file")
    size, small = (1 << s for s in struct.unpack_from("<HH", data, 30))
    n_fat, first_dir, _, cutoff, first_small, _, first_more, _ = struct.unpack_from("<8I", data, 44)
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]

    fat_at = numbers(data[76:512])
    seen: set[int] = set()
    while first_more < LAST_SECTOR and first_more not in seen:
        seen.add(first_more)
        *more, first_more = numbers(sector(first_more))
        fat_at += more
    fat = [n for i in fat_at[:n_fat] if i < LAST_SECTOR for n in numbers(sector(i))]
    joined = lambda start: b"".join(map(sector, _chain(start, fat)))

    entries = []
    table = joined(first_dir)
    for at in range(0, len(table) - 127, 128):
        length, kind = struct.unpack_from("<HB", table, at + 64)
        left, right, child = struct.unpack_from("<III", table, at + 68)
        start, n = struct.unpack_from("<IQ", table, at + 116)
        entries.append((table[at : at + max(length - 2, 0)].decode("utf-16-le", "replace"), kind, left, right, child, start, n))
    if not entries or entries[0][1] != ROOT:
        raise ValueError("a compound file without a root")
    small_next = numbers(joined(first_small))
    small_data = joined(entries[0][5])

    def reader(start: int, n: int) -> Callable[[], bytes]:
        if n >= cutoff:
            return lambda: joined(start)[:n]
        return lambda: b"".join(small_data[i * small : (i + 1) * small] for i in _chain(start, small_next))[:n]

    found: dict[str, Callable[[], bytes]] = {}
    todo, visited = [(entries[0][4], "")], set()
    while todo:
        i, folder = todo.pop()
        if i >= len(entries) or i in visited:  # no entry, or one that is linked twice
            continue
        visited.add(i)
        name, kind, left, right, child, start, n = entries[i]
        todo += [(left, folder), (right, folder)]
        if kind == STORAGE:
            todo.append((child, f"{folder}{name}/"))
        elif kind == STREAM:
            found[folder + name] = reader(start, n)
    return found
