"""Patch formats as functions of bytes, from their public descriptions. A patch that isn't whole, or is for another file, is an error."""

from __future__ import annotations

import zlib


def ips_apply(base: bytes, patch: bytes) -> bytes:
    """IPS: records of a place (3 bytes) and a length (2, 0 for a repeated byte: length and value), EOF, and perhaps a length to cut to; numbers have their high byte first."""
    if patch[:5] != b"PATCH":
        raise ValueError("not an IPS patch")
    out, at = bytearray(base), 5
    number = lambda n: int.from_bytes(patch[at : at + n], "big")
    while patch[at : at + 3] != b"EOF":
        place = number(3)
        at += 3
        size = number(2)
        at += 2
        if size:
            piece = patch[at : at + size]
            at += size
        else:
            size = number(2)
            piece = patch[at + 2 : at + 3] * size
            at += 3
        if at > len(patch) - 3 or not size:
            raise ValueError("the patch is cut off or has an empty run")
        out[len(out) :] = bytes(max(0, place - len(out)))
        out[place : place + size] = piece
    cut = patch[at + 3 : at + 6]
    return bytes(out[: int.from_bytes(cut, "big")] if len(cut) == 3 else out)


def ips_make(base: bytes, target: bytes) -> bytes:
    """An IPS patch with a record for each run of bytes that differ; for targets below 16 MiB."""
    if len(target) > 0xFFFFFF:
        raise ValueError("IPS reaches 16 MiB only")
    out, k, n = bytearray(b"PATCH"), 0, len(target)
    while k < n:
        if k < len(base) and base[k] == target[k]:
            k += 1
            continue
        begin = k - 1 if k == int.from_bytes(b"EOF", "big") else k  # a place that reads EOF would end the patch
        k += 1
        while k < n and k - begin < 0xFFFF and (k >= len(base) or base[k] != target[k]):
            k += 1
        out += begin.to_bytes(3, "big") + (k - begin).to_bytes(2, "big") + target[begin:k]
    return bytes(out + b"EOF" + (n.to_bytes(3, "big") if n < len(base) else b""))


def _number(n: int) -> bytes:
    """Seven bits a byte, the last one marked; each further byte counts from one more."""
    out = bytearray()
    while True:
        out.append(n & 0x7F)
        n >>= 7
        if not n:
            out[-1] |= 0x80
            return bytes(out)
        n -= 1


def bps_apply(base: bytes, patch: bytes) -> bytes:
    """BPS: sizes and metadata, then actions that copy from the base or the result, or give bytes, and CRC-32s of base, result and patch, which are checked."""
    if patch[:4] != b"BPS1" or len(patch) < 19:
        raise ValueError("not a BPS patch")
    sums = [int.from_bytes(patch[len(patch) - k :][:4], "little") for k in (12, 8, 4)]
    if zlib.crc32(patch[:-4]) != sums[2] or zlib.crc32(base) != sums[0]:
        raise ValueError("the patch is damaged, or for another file")
    at = 4

    def number() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            b = patch[at]
            at += 1
            out += (b & 0x7F) << shift
            if b & 0x80:
                return out
            shift += 7
            out += 1 << shift

    if number() != len(base):
        raise ValueError("the base has another length")
    size, metadata = number(), number()
    at += metadata
    out, read, wrote = bytearray(), 0, 0
    while at < len(patch) - 12:
        n = number()
        kind, length = n & 3, (n >> 2) + 1
        if kind == 0:
            out += base[len(out) : len(out) + length]
        elif kind == 1:
            out += patch[at : at + length]
            at += length
        else:
            step = number()
            step = -(step >> 1) if step & 1 else step >> 1
            if kind == 2:
                read += step
                out += base[read : read + length]
                read += length
            else:
                wrote += step
                for _ in range(length):  # may overlap what it writes
                    out.append(out[wrote])
                    wrote += 1
    if len(out) != size or zlib.crc32(out) != sums[1]:
        raise ValueError("the result isn't what the patch says")
    return bytes(out)


def bps_make(base: bytes, target: bytes) -> bytes:
    """A BPS patch of bytes that stay in place, runs of one byte, and others as they are."""
    out, k, n = bytearray(b"BPS1" + _number(len(base)) + _number(len(target)) + _number(0)), 0, len(target)
    same = lambda i: i < len(base) and base[i] == target[i]
    wrote = 0
    while k < n:
        begin = k
        if same(k):
            while k < n and same(k):
                k += 1
            out += _number((k - begin - 1) << 2)
            continue
        run = k + 1
        while run < n and target[run] == target[k] and not same(run):
            run += 1
        if run - k > 8:
            out += _number(1) + target[k : k + 1] + _number((run - k - 2) << 2 | 3) + _number((k - wrote) << 1 if k >= wrote else (wrote - k) << 1 | 1)
            k, wrote = run, run - 1
            continue
        while k < n and not same(k) and k - begin < 1 << 16:
            k += 1
        out += _number((k - begin - 1) << 2 | 1) + target[begin:k]
    out += zlib.crc32(base).to_bytes(4, "little") + zlib.crc32(target).to_bytes(4, "little")
    return bytes(out + zlib.crc32(out).to_bytes(4, "little"))
