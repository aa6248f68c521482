"""ZIP archives by byte ranges: central directory, ZIP64 records and stored members, without extraction."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class ZipError(ValueError):
    pass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int

    @property
    def stored(self) -> bool:
        return self.method == 0


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ZipError(f"short read of {n} bytes at {at}")
    return data


def directory_place(f, size: int) -> tuple[int, int, int]:
    """(entries, bytes, offset) of the central directory, from the end record or its ZIP64 form.

    The end record is looked for backwards, as a comment of up to 65,535 bytes may follow it.
    """
    tail_size = min(size, 22 + MAX16)
    tail = _range(f, size - tail_size, tail_size)
    at = len(tail) - 22
    while at >= 0:
        at = tail.rfind(END, 0, at + 4)
        if at < 0:
            break
        if at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ZipError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    place = size - tail_size + at
    if place >= 20 and (entries == MAX16 or length == MAX32 or offset == MAX32):
        locator = _range(f, place - 20, 20)
        if locator[:4] == LOCATOR64:
            record = _range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ZipError("no ZIP64 end record where its locator points")
            entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return entries, length, offset


def members(f, size: int) -> list[Member]:
    """The central directory's members in order; sizes and offsets of 32 set bits come from the ZIP64 field."""
    entries, length, offset = directory_place(f, size)
    data, at, out = _range(f, offset, length), 0, []
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL:
            raise ZipError(f"no central entry at {offset + at}")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", data, at + 16)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = next(wide) if full == MAX32 else full
                packed = next(wide) if packed == MAX32 else packed
                header = next(wide) if header == MAX32 else header
            e += 4 + n
        out.append(Member(name, method, crc, packed, full, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(f, member: Member) -> int:
    """Where a member's bytes begin; its local header's name and extra field may differ from the directory's."""
    header = _range(f, member.header, 30)
    if header[:4] != LOCAL:
        raise ZipError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


def write_stored(f, parts: list[tuple[str, list[bytes]]], zip64: bool | None = None) -> int:
    """Write an archive of stored members, each given in pieces; its size. zip64: None for where needed."""
    at, central = 0, []
    for name, pieces in parts:
        size, crc = sum(map(len, pieces)), 0
        for piece in pieces:
            crc = zlib.crc32(piece, crc)
        wide = zip64 or (zip64 is None and max(size, at) >= MAX32)
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        s = MAX32 if wide else size
        f.write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(extra)) + raw + extra)
        for piece in pieces:
            f.write(piece)
        more = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(more), 0, 0, 0, 0, MAX32 if wide else at) + raw + more)
        at += 30 + len(raw) + len(extra) + size
    listing = b"".join(central)
    f.write(listing)
    wide = zip64 or (zip64 is None and (at >= MAX32 or len(central) >= MAX16))
    total = at + len(listing) + 22
    if wide:
        f.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(central), len(central), len(listing), at))
        f.write(LOCATOR64 + struct.pack("<IQI", 0, at + len(listing), 1))
        total += 76
    n, size, offset = (MAX16, MAX32, MAX32) if wide else (len(central), len(listing), at)
    f.write(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, offset, 0))
    return total
