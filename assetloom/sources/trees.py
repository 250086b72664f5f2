"""Readers of containers that are trees or chains: nested boxes of AVIF and HEIC, tag directories of TIFF."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its functions travel with the job

# Fixed values of the formats: bytes of a value by TIFF type; boxes that hold boxes, with the bytes before the first.
TIFF_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PARENTS = {"meta": 4, "iprp": 0, "ipco": 0, "moov": 0, "trak": 0}


def tiff(data) -> Iterator[tuple[str, int, int, int]]:
    """``II0:256:3`` for tag 256 of type 3 in directory 0 of a little-endian file; payloads are values, wherever they lie.

    Directories are followed along their chain, each once, until one lies outside the data.
    """
    order = "little" if bytes(data[:2]) == b"II" else "big"
    name = "II" if order == "little" else "MM"
    number = lambda at, n: int.from_bytes(data[at:at + n], order)
    at, seen = number(4, 4), set()
    while at and at not in seen and at + 2 <= len(data):
        k = len(seen)
        seen.add(at)
        count = number(at, 2)
        if at + 2 + 12 * count > len(data):
            return
        for entry in range(at + 2, at + 2 + 12 * count, 12):
            kind, items = number(entry + 2, 2), number(entry + 4, 4)
            size = TIFF_BYTES.get(kind, 0) * items
            start = entry + 8 if size <= 4 else number(entry + 8, 4)
            if size and start + size <= len(data):
                yield f"{name}{k}:{number(entry, 2)}:{kind}", entry, size, start
        at = number(at + 2 + 12 * count, 4) if at + 6 + 12 * count <= len(data) else 0


def _boxes(data, start: int, end: int, depth: int = 0) -> Iterator[tuple[str, int, int, int, int]]:
    """(kind, offset, payload length, payload start, depth), each box before those in it."""
    while start + 8 <= end:
        size, kind, head = int.from_bytes(data[start:start + 4], "big"), bytes(data[start + 4:start + 8]).decode("latin-1"), 8
        if size == 1 and start + 16 <= end:
            size, head = int.from_bytes(data[start + 8:start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start, size - head, start + head, depth
        if kind in PARENTS and depth < 8:
            yield from _boxes(data, start + head + PARENTS[kind], start + size, depth + 1)
        start += size


def _primary_properties(data, boxes) -> set[int]:
    """Numbers (from 1, in order of ``ipco``) of the properties of the primary item."""
    number = lambda at, n: int.from_bytes(data[at:at + n], "big")
    pitm = next((b for b in boxes if b[0] == "pitm"), None)
    if pitm is None:
        return set()
    primary = number(pitm[3] + 4, 4 if number(pitm[3], 1) else 2)
    found: set[int] = set()
    for _, _, size, at, _ in (b for b in boxes if b[0] == "ipma"):
        end, version, wide = at + size, number(at, 1), number(at + 3, 1) & 1
        count, at = number(at + 4, 4), at + 8
        for _ in range(count):
            if at + 3 > end:
                break
            id_bytes = 4 if version else 2
            item, n = number(at, id_bytes), number(at + id_bytes, 1)
            at += id_bytes + 1
            for _ in range(n):
                if item == primary and at < end:
                    found.add(number(at, 2) & 0x7FFF if wide else number(at, 1) & 0x7F)
                at += 2 if wide else 1
    return found


def heif(data) -> Iterator[tuple[str, int, int, int]]:
    """Boxes of the tree by name; properties of the primary item as ``ispe*``, ``irot*``, ``pixi*``, ...

    If no item is named as primary, the largest ``ispe`` counts as its own.
    """
    boxes = list(_boxes(data, 0, len(data)))
    chosen = _primary_properties(data, boxes)
    inside, number, largest = None, 0, None
    for b in boxes:
        if b[0] == "ispe" and b[2] >= 12:
            area = int.from_bytes(data[b[3] + 4:b[3] + 8], "big") * int.from_bytes(data[b[3] + 8:b[3] + 12], "big")
            largest = max(largest or (0, None), (area, -b[1]))
    for kind, offset, size, start, depth in boxes:
        mark = ""
        if kind == "ipco":
            inside, number = depth, 0
        elif inside is not None and depth == inside + 1:
            number += 1
            if number in chosen or (not chosen and kind == "ispe" and largest and offset == -(largest[1] or 0)):
                mark = "*"
        elif inside is not None and depth <= inside:
            inside = None
        yield kind + mark, offset, size, start
