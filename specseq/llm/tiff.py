"""TIFF media columns: one row for each page of the files in a binary column.

The reader walks the chain of image directories, decodes strips or tiles that
are stored plain or by PackBits, LZW or deflate, undoes the horizontal and the
floating-point predictor, and joins planes. The writer stores 8-bit samples.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

#: Tag numbers of TIFF 6.0 and its supplements.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE_NEW, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
#: Struct codes of the field types.
KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: A byte of stored data stands for so many at most (LZW's longest string for a 12-bit code), and a page has so many bytes at most; a page that claims more is broken.
MOST_TIMES, MOST_BYTES = 2600, 1 << 30
PAGES = "page int, width long, height long, samples int, bits int, compression string, pixels binary, error string"


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while at + run < n and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at
        while end < n and end - at < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, widened one code early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if not last:
            last = table[code]
        else:
            if code > len(table) or len(table) > 4096:
                raise ValueError("broken LZW data")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            last = word
        out += last
        if len(out) >= size:
            break
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    table, word = {bytes([i]): i for i in range(256)}, b""
    size = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


NAMES = {PLAIN: "none", LZW: "lzw", DEFLATE_NEW: "deflate", DEFLATE_OLD: "deflate", PACKBITS: "packbits"}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE_NEW, predictor: int = 2, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian TIFF with one directory for each array of shape (height, width) or (height, width, samples), 8 bits a sample."""
    pack = {PLAIN: bytes, LZW: pack_lzw, DEFLATE_NEW: lambda b: zlib.compress(b, 1), DEFLATE_OLD: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}[compression]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        image = page.reshape(*page.shape[:2], -1)
        height, width, samples = image.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), np.uint8)
            padded[:height, :width] = image
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = pack(block.astype(np.uint8).tobytes())
            places.append(len(out))
            sizes.append(len(data))
            out += data
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        tags += [(SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, places), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, at = struct.pack("<I", len(out)), data
                out += at
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes):
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories has a loop")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in KINDS:
                code = f"{order}{n}{KINDS[kind]}"
                place = at + 10 + 12 * i
                if struct.calcsize(code) > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = struct.unpack_from(code, data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _block(raw: bytes, compression: int, predictor: int, shape: tuple[int, int, int], dtype: np.dtype) -> np.ndarray:
    size = math.prod(shape) * dtype.itemsize
    if size > len(raw) * MOST_TIMES:
        raise ValueError("a strip or tile claims more than its data can hold")
    if compression == PLAIN:
        got = raw
    elif compression == PACKBITS:
        got = unpack_bits(raw, size)
    elif compression == LZW:
        got = unpack_lzw(raw, size)
    elif compression in (DEFLATE_NEW, DEFLATE_OLD):
        got = zlib.decompressobj().decompress(raw, size)
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(got) < size:
        raise ValueError("a strip or tile is cut off")
    if predictor == 3:
        rows, cols, samples = shape
        planes = np.cumsum(np.frombuffer(got, np.uint8, size).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape).astype(dtype)
    block = np.frombuffer(got, dtype, math.prod(shape)).reshape(shape)
    return np.cumsum(block, axis=1, dtype=dtype) if predictor == 2 else block


def read_tiff(data: bytes):
    """Yield (array of shape (height, width, samples), compression) for each page, in the order of the directories."""
    for order, tags in _directories(data):
        one = lambda tag, default, tags=tags: tags.get(tag, (default,))[0]
        width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
        bits, kind, compression, predictor = one(BITS, 1), one(FORMAT, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if min(width, height, samples, bits) < 1:
            raise ValueError("an image without pixels")
        if bits % 8 or bits > 64 or any(b != bits for b in tags.get(BITS, (1,))):
            raise ValueError(f"{bits} bits a sample aren't supported")
        dtype = np.dtype(f"{order}{'f' if kind == 3 else 'i' if kind == 2 else 'u'}{bits // 8}")
        tiled = TILE_OFFSETS in tags
        bh, bw = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
        offsets, sizes = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES]
        if min(bh, bw) < 1:
            raise ValueError("strips or tiles without pixels")
        planes = samples if one(PLANAR, 1) == 2 else 1
        if width * height * samples * dtype.itemsize > min(MOST_BYTES, MOST_TIMES * len(data)) or len(offsets) != planes * -(-height // bh) * -(-width // bw):
            raise ValueError("the image's size doesn't go with its data")
        depth = samples // planes
        image = np.zeros((height, width, samples), dtype)
        down, across = -(-height // bh), -(-width // bw)
        for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
            plane, rest = divmod(i, down * across)
            y, x = rest // across * bh, rest % across * bw
            rows = bh if tiled else min(bh, height - y)
            block = _block(data[at : at + size], compression, predictor, (rows, bw, depth), dtype)
            image[y : y + rows, x : x + bw, plane * depth : (plane + 1) * depth] = block[: height - y, : width - x]
        yield image, NAMES[compression]


def _pages_of(data: bytes | None):
    """Rows as in PAGES of one file. A null, empty or broken file ends in a row with page -1 and the reason, whatever its headers say."""
    i = 0
    try:
        for i, (image, how) in enumerate(read_tiff(data or b"")):  # noqa: B007
            yield i, image.shape[1], image.shape[0], image.shape[2], image.dtype.itemsize * 8, how, image.tobytes(), None
    except (ValueError, TypeError, LookupError, ArithmeticError, struct.error, zlib.error) as e:
        yield -1, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def _by_page(files: DataFrame, content: str, keep: list[str], schema: str, kinds: list, row) -> DataFrame:
    """mapInArrow over the pages of the files in content: the columns in keep, then what row(file, page) gives."""
    files = files.select(*keep, files[content].cast("binary").alias(content))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in keep)
    names = [*keep, *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        for batch in in_slices(batches, content):
            of, rows = [], []
            for i, data in enumerate(batch.column(len(keep)).to_pylist()):
                for page in _pages_of(data):
                    of.append(i)
                    rows.append(row(data, page))
            if rows:
                own = [c.take(pa.array(of)) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays(own + [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, f"{kept}, {schema}")


def tiff_pages(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """One row for each page: the columns in keep, then PAGES; pixels in row order, samples side by side.

    A null, empty or broken file gives one row with page -1 and the reason in
    ``error``; pages before the break are kept. Repeated rows and null keys give
    rows each. Columns outside keep and content are left out.
    """
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
    return _by_page(files, content, keep, PAGES, kinds, lambda data, page: page)


def texts_as_tiff(docs: DataFrame, width: int = 192) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a one-page grey image, padded by spaces to full rows. A null text is empty and gives one row of spaces."""

    def run(batches):
        for batch in in_slices(batches):
            raw = [t.encode() for t in (x or "" for x in batch.column(1).to_pylist())]
            media = []
            for b in raw:
                rows = max(1, -(-len(b) // width))
                media.append(write_tiff([np.frombuffer(b.ljust(rows * width), np.uint8).reshape(rows, width)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def page_feature(pixels: bytes, width: int, height: int) -> str:
    """Size, mean and entropy of the samples."""
    seen = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
    total = int(seen.sum())
    share = seen[seen > 0] / total
    return f"{width}x{height} mean={int(seen @ np.arange(256)) / total:.6f} entropy={float(-(share * np.log2(share)).sum()):.6f}"


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """Digests and a feature of each page that is read back from the rows of texts_as_tiff(). Pixels stay in the task that decodes them."""

    def row(data, page):
        pixels = page[6]
        if pixels is None:
            return None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), page[7]
        return len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-16:]), len(data), hashlib.sha256(data).hexdigest(), page_feature(pixels, page[1], page[2])

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _by_page(media, "media", ["doc_id", "n_bytes"], DIGEST, kinds, row)
