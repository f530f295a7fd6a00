"""Small codecs in NumPy and the standard library: 8-bit PNG, single-channel EXR, npz and zips of images."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np


def png_encode(image: np.ndarray) -> bytes:
    """A greyscale image (h, w) or an RGB one (h, w, 3) of uint8."""
    h, w = image.shape[:2]
    channels = 1 if image.ndim == 2 else 3
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * channels).astype(np.uint8)], 1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """uint8 (h, w) or (h, w, channels) of an 8-bit, non-interlaced PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in (0, 2, 3, 4, 6):
        raise ValueError("only 8-bit PNGs without interlacing")
    bpp = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), np.uint8)
    for y in range(h):
        kind, line, above = raw[y, 0], raw[y, 1:].astype(np.int64), out[y - 1].astype(np.int64) if y else np.zeros(w * bpp, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + above) & 255
        elif kind == 1:
            out[y] = (np.cumsum(line.reshape(w, bpp), 0) & 255).reshape(-1)
        else:
            row = np.zeros(w * bpp, np.int64)
            for x in range(w * bpp):
                a, b, c = (row[x - bpp] if x >= bpp else 0), above[x], (above[x - bpp] if x >= bpp else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (line[x] + guess) & 255
            out[y] = row
    return out.reshape(h, w) if bpp == 1 else out.reshape(h, w, bpp)


def _attribute(name: str, kind: str, value: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value


def exr_encode(depth: np.ndarray) -> bytes:
    """One half-precision channel Z, uncompressed scan lines."""
    h, w = depth.shape
    box = struct.pack("<4i", 0, 0, w - 1, h - 1)
    channels = b"Z\0" + struct.pack("<iB3xii", 1, 0, 1, 1) + b"\0"
    head = struct.pack("<ii", 20000630, 2) + _attribute("channels", "chlist", channels) + _attribute("compression", "compression", b"\0") + _attribute("dataWindow", "box2i", box) + _attribute("displayWindow", "box2i", box) + _attribute("lineOrder", "lineOrder", b"\0") + _attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + _attribute("screenWindowCenter", "v2f", struct.pack("<ff", 0, 0)) + _attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    lines = [struct.pack("<ii", y, 2 * w) + depth[y].astype("<f2").tobytes() for y in range(h)]
    first = len(head) + 8 * h
    offsets = first + np.concatenate([[0], np.cumsum([len(x) for x in lines])[:-1]]) if h else np.zeros(0)
    return head + offsets.astype("<u8").tobytes() + b"".join(lines)


def exr_decode(data: bytes) -> np.ndarray:
    """float32 of the channel Z of an uncompressed or zip-compressed scan-line file of one half or float channel."""
    if struct.unpack("<i", data[:4])[0] != 20000630:
        raise ValueError("not an EXR file")
    at, attributes = 8, {}
    while data[at] != 0:
        end = data.index(b"\0", at)
        name, at = data[at:end].decode(), end + 1
        at = data.index(b"\0", at) + 1
        n = struct.unpack("<i", data[at : at + 4])[0]
        attributes[name] = data[at + 4 : at + 4 + n]
        at += 4 + n
    at += 1
    x0, y0, x1, y1 = struct.unpack("<4i", attributes["dataWindow"])
    w, h, packing = x1 - x0 + 1, y1 - y0 + 1, attributes["compression"][0]
    kind = "<f2" if struct.unpack("<i", attributes["channels"][2:6])[0] == 1 else "<f4"
    per = {0: 1, 2: 1, 3: 16}.get(packing)
    if per is None:
        raise ValueError("compression is not supported")
    out = np.zeros((h, w), np.float32)
    for offset in np.frombuffer(data, "<u8", -(-h // per), at):
        y, n = struct.unpack("<ii", data[offset : offset + 8])
        raw = data[offset + 8 : offset + 8 + n]
        rows = min(per, h - (y - y0))
        if packing and n < rows * w * np.dtype(kind).itemsize:
            b = np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.int64)
            b[1:] -= 128
            b = (np.cumsum(b) & 255).astype(np.uint8)
            half = (len(b) + 1) // 2
            mixed = np.zeros(len(b), np.uint8)
            mixed[0::2], mixed[1::2] = b[:half], b[half:]
            raw = mixed.tobytes()
        out[y - y0 : y - y0 + rows] = np.frombuffer(raw, kind, rows * w).reshape(rows, w)
    return out


def zip_members(data: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(n, z.read(n)) for n in sorted(z.namelist())]


def zip_build(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def npz_read(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def npz_build(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()
