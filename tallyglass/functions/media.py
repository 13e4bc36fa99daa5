"""Binary image functions: format, geometry, container signature, trailing data. JVM expressions where bytes at fixed places
suffice, else kernels for Arrow-batched UDFs."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes of formats, in hex.
MAGICS = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "474946383", "bmp": "424D", "tiff": "49492A00", "tiff-be": "4D4D002A", "webp": "52494646"}
#: What trailing data may begin with.
TRAILERS = {
    b"PK\x03\x04": "zip", b"Rar!\x1a\x07": "rar", b"7z\xbc\xaf\x27\x1c": "7z", b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"%PDF": "pdf",
    b"\x89PNG": "png", b"\xff\xd8\xff": "jpeg", b"GIF8": "gif", b"ID3": "mp3", b"OggS": "ogg", b"\x7fELF": "elf",
}
MOST_SEGMENTS = 256
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def sniff(content: Column | str) -> Column:
    """Format by the leading bytes; null where none fits."""
    head = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 16))
    out = None
    for name, magic in MAGICS.items():
        hit = head.startswith(magic) & (head.substr(17, 8) == "57454250" if name == "webp" else F.lit(True))
        name = name.removesuffix("-be")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _number(content: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")


def png_geometry(content: Column | str) -> Column:
    """``width, height, depth, channels`` of a PNG's first chunk; null for anything else."""
    c = F.col(content) if isinstance(content, str) else content
    ok = (F.hex(F.substring(c, 1, 8)) == MAGICS["png"]) & (F.hex(F.substring(c, 13, 4)) == "49484452") & (F.octet_length(c) >= 26)
    channels = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])[_number(c, 26, 1)]
    return F.when(ok, F.struct(_number(c, 17, 4).alias("width"), _number(c, 21, 4).alias("height"), _number(c, 25, 1).alias("depth"), channels.alias("channels")))


def jpeg_segments(data: bytes) -> list[tuple[int, int, int]]:
    """``(marker, begin, length)`` of the segments up to the scan, at most ``MOST_SEGMENTS``; what is malformed ends the walk."""
    out, at = [], 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and len(out) < MOST_SEGMENTS:
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        if size < 2:
            break
        out.append((marker, at + 4, size - 2))
        if marker == 0xDA:
            break
        at += 2 + size
    return out


def geometry(data: bytes | None) -> tuple[int, int, int, int] | None:
    """``(width, height, depth, channels)`` of a PNG or JPEG header."""
    if not data:
        return None
    if data[:8] == bytes.fromhex(MAGICS["png"]) and data[12:16] == b"IHDR" and len(data) >= 26:
        w, h, depth, kind = struct.unpack(">IIBB", data[16:26])
        return (w, h, depth, CHANNELS[kind]) if kind in CHANNELS else None
    for marker, at, size in jpeg_segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and size >= 6 and at + 6 <= len(data):
            depth, h, w, channels = struct.unpack(">BHHB", data[at : at + 6])
            return w, h, depth, channels
    return None


def png_chunks(data: bytes) -> list[tuple[bytes, int, int]]:
    """``(type, begin, length)`` of the complete chunks."""
    out, at = [], 8
    while data[:8] == bytes.fromhex(MAGICS["png"]) and at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if at + 12 + size > len(data):
            break
        out.append((data[at + 4 : at + 8], at + 8, size))
        at += 12 + size
        if out[-1][0] == b"IEND":
            break
    return out


def container(data: bytes | None) -> str | None:
    """What a file is made of, as text: chunks with runs of image data collapsed, or markers before the scan, the size header
    by content. Null for other files, so that two unknown ones never look alike."""
    if not data:
        return None
    parts: list[str] = []
    for kind, at, size in png_chunks(data):
        name = kind.decode("latin-1")
        part = f"{name}:{data[at : at + size].hex()}" if name == "IHDR" else name
        if not (name == "IDAT" and parts and parts[-1] == "IDAT"):
            parts.append(part)
    if parts:
        return "png " + " ".join(parts)
    for marker, at, size in jpeg_segments(data):
        frame = 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        parts.append(f"{marker:02x}:{data[at : at + size].hex()}" if frame else f"{marker:02x}")
    return "jpeg " + " ".join(parts) if parts else None


def logical_end(data: bytes) -> int | None:
    """Where the image ends: behind the end chunk or the end marker of the last scan; null if it doesn't."""
    chunks = png_chunks(data)
    if chunks:
        kind, at, size = chunks[-1]
        return at + size + 4 if kind == b"IEND" else None
    segments = jpeg_segments(data)
    if not segments or segments[-1][0] != 0xDA:
        return None
    at = segments[-1][1] + segments[-1][2]
    while True:  # entropy-coded data: only a marker other than a stuffed byte or restart ends it
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return None
        code = data[at + 1]
        if code == 0xD9:
            return at + 2
        if code == 0 or code == 0xFF or 0xD0 <= code <= 0xD7:
            at += 1 if code == 0xFF else 2
            continue
        if at + 4 > len(data):
            return None
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]


def trailing(data: bytes | None) -> tuple[int, str | None]:
    """Bytes behind the image's end and what they look like; (-1, null) where there is no image end."""
    end = logical_end(data) if data else None
    if end is None:
        return -1, None
    rest = data[end:]
    if not rest:
        return 0, None
    for magic, kind in TRAILERS.items():
        if rest.startswith(magic):
            return len(rest), kind
    text = sum(32 <= b < 127 or b in (9, 10, 13) for b in rest[:512])
    return len(rest), "text" if text >= 0.95 * min(len(rest), 512) else None


def inspect(content: Column) -> Column:
    """``width, height, depth, channels, container, trailing_bytes, trailing_kind`` of image bytes, in Arrow batches."""

    @F.pandas_udf("width int, height int, depth int, channels int, container string, trailing_bytes long, trailing_kind string")
    def run(col: pd.Series) -> pd.DataFrame:
        rows = []
        for data in col:
            n, kind = trailing(data)
            rows.append((*(geometry(data) or (None,) * 4), container(data), n, kind))
        return pd.DataFrame(rows, columns=["width", "height", "depth", "channels", "container", "trailing_bytes", "trailing_kind"])

    return run(content)


def shape_difference(a: str, b: str) -> Column:
    """The first thing two shapes (struct columns ``format, width, height, depth, channels``) differ in; null if nothing known does."""
    x, y = F.col(a), F.col(b)
    size = (x["width"] != y["width"]) | (x["height"] != y["height"])
    return (
        F.when(x["format"] != y["format"], F.concat(x["format"], F.lit(" / "), y["format"]))
        .when(size, F.format_string("%dx%d / %dx%d", x["width"], x["height"], y["width"], y["height"]))
        .when(x["depth"] != y["depth"], F.format_string("%d / %d bits", x["depth"], y["depth"]))
        .when(x["channels"] != y["channels"], F.format_string("%d / %d channels", x["channels"], y["channels"]))
    )


def texture(grey) -> float:
    """Mean absolute four-neighbour Laplacian of a grey image."""
    import numpy as np

    g = np.asarray(grey, float)
    if min(g.shape) < 3:
        return 0.0
    return float(np.abs(4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]).mean())


def clipped_fraction(grey) -> float:
    """Share of pixels at either end of the range."""
    import numpy as np

    g = np.asarray(grey)
    return float(((g <= 0) | (g >= 255)).mean()) if g.size else 0.0
