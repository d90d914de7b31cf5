"""TIFF media columns: texts' bytes as TIFF files, and TIFF files read into one row per page.

The reader walks the chain of image directories of either byte order (classic TIFF), gathers strips
or tiles, decodes them (none, PackBits, LZW, deflate), undoes the horizontal predictor and yields a
page's samples. 8 and 16 bits a sample, any number of samples, chunky or planar. A file that it can't
read gives one row with page 0, no samples and the reason in ``error``; pages before the fault stay.
Null media gives one row with the error "null". Empty tables give empty tables.

The writer turns bytes into pages of 8-bit RGB, 64 pixels (192 bytes) a row and at most 256 rows a
page, padded with spaces. Pages take turns at the LAYOUTS (deflate, PackBits and LZW; strips and
tiles; with and without predictor; each in equal shares), from a place that depends on the bytes alone.
Equal bytes give equal files.

Nothing is decoded beyond the samples that a strip or tile must have, and a page whose header claims more samples
than its file can hold is a fault.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import rows, utf8

# Fixed values of the format: tags, compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

ROW_PIXELS, PAGE_ROWS, STRIP_ROWS, TILE_WIDE, TILE_HIGH = 64, 256, 64, 32, 16
ROW_BYTES = 3 * ROW_PIXELS

_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(data: bytes) -> bytes:
    out, at = [], 0

    def literal(stop: int) -> None:
        for a in range(at, stop, 128):
            b = min(stop, a + 128)
            out.append(bytes([b - a - 1]))
            out.append(data[a:b])

    for m in _RUN.finditer(data):
        literal(m.start())
        out.append(bytes([257 - (m.end() - m.start()), data[m.start()]]))
        at = m.end()
    literal(len(data))
    return b"".join(out)


def unpackbits(data: bytes, need: int = 1 << 62) -> bytes:
    """The first ``need`` bytes, and at most 127 more."""
    out, i, n, made = [], 0, len(data), 0
    while i < n and made < need:
        k = data[i]
        made += k + 1 if k < 128 else 257 - k
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += 2 + k
        else:
            if k > 128 and i + 1 < n:
                out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2 if k > 128 else 1
    return b"".join(out)


def _widths(n: int) -> np.ndarray:
    """Bits of each of the n codes after a clear: a reader's table has an entry more with every code
    but the first, and the width grows one entry early."""
    held = 257 + np.arange(n)
    return 9 + (held >= 511).astype(np.int64) + (held >= 1023) + (held >= 2047)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: 9 to 12 bits, the most significant first, a clear before the table is full."""
    runs: list[list[int]] = [[256]]
    run: list[int] = []
    add, table, size, code = run.append, {}, 258, -1
    get = table.get
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        if (longer := get(key)) is not None:
            code = longer
            continue
        add(code)
        table[key] = size
        size += 1
        code = byte
        if size == 4094:
            add(256)
            runs.append(run)
            run, table, size = [], {}, 258
            add, get = run.append, table.get
    if code >= 0:
        add(code)
    add(257)
    runs.append(run)
    codes = np.array([c for r in runs for c in r], np.uint16)
    width = np.concatenate([np.array([9])] + [_widths(len(r)) for r in runs[1:]])
    wide = np.unpackbits(codes.astype(">u2").view(np.uint8)).reshape(-1, 16)[:, 4:]
    return np.packbits(wide[np.arange(12) >= 12 - width[:, None]]).tobytes()


#: Codes that a table takes in before it must be cleared, and their widths.
_RUN_CODES = 4096 - 256
_RUN_WIDTHS = _widths(_RUN_CODES)
_RUN_ENDS = np.cumsum(_RUN_WIDTHS)
_BYTES = [bytes([i]) for i in range(256)] + [b"", b""]


def unlzw(data: bytes, need: int = 1 << 62) -> bytes:
    """The first ``need`` bytes, and those of their last code. Codes between two clears are cut out together."""
    raw, out, made, bit = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64), [], 0, 0
    while made < need:
        n = int(np.searchsorted(_RUN_ENDS, 8 * len(data) - bit, "right"))
        if not n:
            break
        width, at = _RUN_WIDTHS[:n], _RUN_ENDS[:n] - _RUN_WIDTHS[:n] + bit
        place = at >> 3
        codes = ((raw[place] << 16 | raw[place + 1] << 8 | raw[place + 2]) >> (24 - (at & 7) - width)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes | 1) == 257)
        if not len(stops) and n == _RUN_CODES:
            raise ValueError("LZW table isn't cleared in time")
        stop = int(stops[0]) if len(stops) else n
        table, prev = list(_BYTES), b""
        add, grow = out.append, table.append
        for code in codes[:stop].tolist():
            if not prev:
                if code > 255:
                    raise ValueError("LZW run begins beyond the bytes")
                now = table[code]
            else:
                if code < len(table):
                    now = table[code]
                elif code == len(table):
                    now = prev + prev[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                grow(prev + now[:1])
            add(now)
            prev = now
            made += len(now)
            if made >= need:
                break
        if stop == n or codes[stop] == 257:
            break
        bit = int(at[stop] + width[stop])
    return b"".join(out)


_ENCODE = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1)}


def _inflate(data: bytes, need: int) -> bytes:
    return zlib.decompressobj().decompress(data, need)


_DECODE = {NONE: lambda d, need: d[:need], PACKBITS: unpackbits, LZW: unlzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
#: Bytes of samples that a byte of a file stands for at most: LZW's longest, 12 bits for 3,837 bytes.
LARGEST = 2_600
#: (compression, tiled, predictor) of the writer's pages, in turn.
LAYOUTS = tuple((how, tiled, predictor) for predictor in (1, 2) for tiled in (False, True) for how in (DEFLATE, PACKBITS, LZW))


def padded(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of a row."""
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES, b" ")


def write(payload: bytes, page_rows: int = PAGE_ROWS) -> bytes:
    """A little-endian TIFF of the payload, whose length must be a positive multiple of ROW_BYTES."""
    out, turn, link = bytearray(b"II*\0\0\0\0\0"), zlib.crc32(payload), 4
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 3)
    for page, top in enumerate(range(0, len(image), page_rows)):
        part = image[top : top + page_rows]
        how, tiled, predictor = LAYOUTS[(turn + page) % len(LAYOUTS)]
        if tiled:
            tall = np.zeros((-(-len(part) // TILE_HIGH) * TILE_HIGH, ROW_PIXELS, 3), np.uint8)
            tall[: len(part)] = part
            blocks = [tall[y : y + TILE_HIGH, x : x + TILE_WIDE] for y in range(0, len(tall), TILE_HIGH) for x in range(0, ROW_PIXELS, TILE_WIDE)]
        else:
            blocks = [part[y : y + STRIP_ROWS] for y in range(0, len(part), STRIP_ROWS)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            made = _ENCODE[how](block.tobytes())
            offsets.append(len(out))
            counts.append(len(made))
            out += made
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 3, [ROW_PIXELS]), (HEIGHT, 4, [len(part)]), (BITS, 3, [8, 8, 8]), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [2]), (SAMPLES, 3, [3]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 3, [TILE_WIDE]), (TILE_HEIGHT, 3, [TILE_HIGH]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tiled else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 3, [STRIP_ROWS]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                raw, at = struct.pack("<I", len(out)), raw
                out += at + b"\0" * (len(at) % 2)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    tiled: bool
    pixels: bytes


def pages(media: bytes) -> Iterator[Page]:
    """The pages of a TIFF file, in the order of its directories."""
    end = {b"II": "<", b"MM": ">"}.get(media[:2])
    if end is None or struct.unpack(end + "H", media[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at, seen, n = struct.unpack(end + "I", media[4:8])[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("the directories' chain has a loop")
        seen.add(at)
        count = struct.unpack_from(end + "H", media, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(count):
            tag, kind, k = struct.unpack_from(end + "HHI", media, at + 2 + 12 * i)
            size = TYPE_SIZE.get(kind, 1) * k
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(end + "I", media, at + 10 + 12 * i)[0]
            if place + size > len(media):
                raise ValueError(f"field {tag} lies beyond the file")
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            tags[tag] = struct.unpack_from(f"{end}{k}{letter}", media, place) if letter else ()
        yield _page(media, end, tags, n)
        n += 1
        at = struct.unpack_from(end + "I", media, at + 2 + 12 * count)[0]


def _page(media: bytes, end: str, tags: dict[int, tuple], n: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag not in tags and default is None:
            raise ValueError(f"page {n} has no field {tag}")
        return tags.get(tag, (default,))[0]

    width, height, samples, bits, how = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE)
    planar, predictor, tiled = one(PLANAR, 1), one(PREDICTOR, 1), TILE_OFFSETS in tags
    if bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1 or how not in _DECODE or predictor not in (1, 2):
        raise ValueError(f"page {n}: {bits} bits, compression {how}, predictor {predictor} aren't read")
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if min(width, height, samples, bw, bh) < 1:
        raise ValueError(f"page {n} has a size of 0")
    offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    across, down = -(-width // bw), -(-height // bh)
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    kind = np.dtype(np.uint8 if bits == 8 else end + "u2")
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError(f"page {n} has too few strips or tiles")
    if down * bh * across * bw * samples * kind.itemsize > LARGEST * (len(media) + 1):
        raise ValueError(f"page {n} claims more samples than its file can hold")
    image = np.zeros((down * bh, across * bw, samples), kind)
    for k in range(across * down * planes):
        plane, y, x = k // (across * down), k % (across * down) // across, k % across
        high = bh if tiled else min(bh, height - y * bh)
        need = high * bw * each * kind.itemsize
        raw = _DECODE[how](media[offsets[k] : offsets[k] + counts[k]], need)[:need]
        if len(raw) < need:
            raise ValueError(f"page {n}: a strip or tile is short")
        block = np.frombuffer(raw, kind).reshape(high, bw, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        image[y * bh : y * bh + high, x * bw : (x + 1) * bw, plane : plane + each] = block
    return Page(n, width, height, samples, bits, how, tiled, image[:height, :width].tobytes())


def write_tiff(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a column of TIFF files that hold the text's UTF-8 bytes. Null text is taken as empty: a row of spaces."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema.fields if f.name != media), T.StructField(media, T.BinaryType())])
    kept = [f.name for f in df.schema.fields if f.name != media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                made = [write(padded(t or b"")) for t in rows(some, "__bytes").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows(some, c) for c in kept), pa.array(made, pa.binary())], names=[*kept, media])

    return df.select(*(F.col(f"`{c}`") for c in kept), utf8(F.col(f"`{text}`")).alias("__bytes")).mapInArrow(run, schema)


PAGE_COLUMNS = "page int, n_pages int, width int, height int, samples int, bits int, compression int, tiled boolean, pixels binary, error string"


def read_tiff(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """One row per page: the kept columns, then PAGE_COLUMNS. Pages of a file follow one another in order
    within a partition; the last one alone has n_pages."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    page_names = [x.split()[0] for x in PAGE_COLUMNS.split(", ")]
    page_types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                at, found = [], []
                for i, m in enumerate(rows(some, "__media").to_pylist()):
                    mine, error = [], None
                    try:
                        if m is None:
                            raise ValueError("null")
                        for p in pages(m):
                            mine.append([p.page, None, p.width, p.height, p.samples, p.bits, p.compression, p.tiled, p.pixels, None])
                    except (ValueError, ArithmeticError, struct.error, zlib.error, LookupError, MemoryError) as e:
                        error = str(e) or type(e).__name__
                    if error or not mine:
                        mine.append([len(mine), None, None, None, None, None, None, None, None, error or "no directory"])
                    mine[-1][1] = len(mine)
                    at += [i] * len(mine)
                    found += mine
                held = some.take(pa.array(at, pa.int64()))
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), page_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows(held, c) for c in keep), *columns], names=[*keep, *page_names])

    return df.select(*keep, F.col(media).alias("__media")).mapInArrow(run, f"{kinds}, {PAGE_COLUMNS}")


def page_digests(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of read_tiff folded into one row per file: the kept columns, payload_bytes, payload_sha256,
    tail_crc32 (of the last 16 bytes) and feature. Goes along the partition; nothing is shuffled."""
    import hashlib

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n, tail, counts, layouts = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), []
        for batch in batches:
            ends, made = [], []
            columns = [rows(batch, c).to_pylist() for c in ("n_pages", "pixels", "compression", "tiled", "error")]
            for i, (last, pixels, how, tiled, error) in enumerate(zip(*columns, strict=True)):
                if error is None:
                    digest.update(pixels)
                    n, tail = n + len(pixels), (tail + pixels[-16:])[-16:]
                    counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                    layouts.append(f"{how}{'t' if tiled else 's'}")
                if last is not None:
                    share = counts[counts > 0] / max(1, n)
                    feature = f"pages={len(layouts)};layout={','.join(sorted(set(layouts)))};distinct={len(share)};mean={int((counts * np.arange(256)).sum()) * 1000 // max(1, n)};top={int(counts.argmax())}"
                    ends.append(i)
                    made.append((n, digest.hexdigest(), zlib.crc32(tail), feature))
                    digest, n, tail, counts, layouts = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), []
            if ends:
                held = batch.take(pa.array(ends, pa.int64()))
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows(held, c) for c in keep), *columns], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return df.mapInArrow(run, f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
