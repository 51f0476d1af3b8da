"""Media columns: TIFF files of several pages, written, walked and decoded.

The reader walks the chain of image directories of either byte order, decodes
strips and tiles stored plainly or by PackBits, LZW or deflate, undoes the
horizontal predictor, and gives one row for each page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Codes of the format.
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
DEFLATE = (8, 32946)
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 284, 317, 322, 323, 324, 325
#: Bytes of texts or files that a worker holds at a time, beyond the one at hand.
HELD = 16 << 20


def packbits(data: bytes) -> bytes:
    """Runs of 3 or more equal bytes as repeats, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate([[0], np.nonzero(np.diff(a))[0] + 1])
    sizes = np.diff(np.append(starts, len(a)))
    out, at = bytearray(), 0
    def literal(lo: int, hi: int) -> None:
        for k in range(lo, hi, 128):
            part = data[k : min(k + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)
    for k in np.nonzero(sizes >= 3)[0].tolist():
        start, left = int(starts[k]), int(sizes[k])
        literal(at, start)
        at = start + left
        while left >= 2:
            n = min(128, left)
            out += bytes((257 - n, data[start]))
            left -= n
        if left:
            out += bytes((0, data[start]))
    literal(at, len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
                at += 2
            else:
                at += 1
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, cleared before 4096."""
    out, buffer, held, width, table, prefix = bytearray(), 0, 0, 9, {}, b""

    def put(code: int) -> None:
        nonlocal buffer, held
        buffer, held = buffer << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(buffer >> held & 255)
        buffer &= (1 << held) - 1

    put(256)
    table, size = {bytes([b]): b for b in range(256)}, 258
    for k in range(len(data)):
        longer = prefix + data[k : k + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer], size = size, size + 1
        # the width changes one code early, as the format has it
        width = min(12, max(9, size.bit_length() if size + 1 < 1 << size.bit_length() else size.bit_length() + 1))
        if size >= 4094:
            put(256)
            table, size, width = {bytes([b]): b for b in range(256)}, 258, 9
        prefix = data[k : k + 1]
    if prefix:
        put(table[prefix])
        size += 1
        width = min(12, max(9, size.bit_length() if size + 1 < 1 << size.bit_length() else size.bit_length() + 1))
    put(257)
    if held:
        out.append(buffer << 8 - held & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, bits, held, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    previous = b""
    while len(out) < size:
        while held < width:
            if at >= len(data):
                raise ValueError("LZW data end early")
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFF, held + 8, at + 1
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = [*(bytes([b]) for b in range(256)), b"", b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not previous) or code in (256, 257):
            raise ValueError(f"LZW code {code} beyond a table of {len(table)}")
        entry = table[code] if code < len(table) else previous + previous[:1]
        out += entry
        if previous:
            table.append(previous + entry[:1])
        n = len(table) + 1
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
        previous = entry
    return bytes(out[:size])


def encode_block(data: bytes, compression: str) -> bytes:
    if compression == "deflate":
        return zlib.compress(data, 1)
    return {"none": bytes, "packbits": packbits, "lzw": lzw}[compression](data)


def decode_block(data: bytes, code: int, size: int) -> bytes:
    """``size`` bytes from a strip or tile."""
    if code in DEFLATE:
        out = zlib.decompress(data)
    elif code == 1:
        out = data
    elif code == 5:
        out = unlzw(data, size)
    elif code == 32773:
        out = unpackbits(data, size)
    else:
        raise ValueError(f"compression {code} is not supported")
    if len(out) < size:
        raise ValueError(f"a block has {len(out)} of {size} bytes")
    return out[:size]


def write_tiff(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, tile: tuple[int, int] | None = None, strip_rows: int = 64, order: str = "<") -> bytes:
    """A TIFF of 8-bit grey pages ``[height, width]``, in strips or ``tile = (height, width)``."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            th, tw = tile
            padded = np.pad(page, ((0, -height % th), (0, -width % tw)))
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            data = encode_block(block.tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [COMPRESSIONS[compression]]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILES, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIPS, 4, offsets), (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                value, here = struct.pack(order + "I", len(out)), value
                out += here
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, along the chain; a loop in it is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            here = at + 10 + 12 * k
            if count * TYPE_SIZES.get(kind, 0) > 4:
                here = struct.unpack_from(order + "I", data, here)[0]
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{order}{count}{'BxHI'[kind - 1]}", data, here)
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """Samples ``[height, width * samples]`` of one directory, also where each sample has a plane of its own."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    if any(b != 8 for b in tags.get(BITS, (8,))):
        raise ValueError("only samples of 8 bits are read")
    planes = samples if one(PLANES, 1) == 2 else 1
    tiled = TILES in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    across, down = -(-width // bw), -(-height // bh)
    out = np.zeros((down * bh, across * bw, samples), np.uint8)
    places = list(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    if len(places) != across * down * planes:
        raise ValueError(f"{len(places)} blocks for {across * down * planes}")
    for k, (at, size) in enumerate(places):
        plane, place = divmod(k, across * down)
        y, x = place // across * bh, place % across * bw
        rows, depth = bh if tiled else min(bh, height - y), samples // planes
        block = np.frombuffer(decode_block(data[at : at + size], one(COMPRESSION, 1), rows * bw * depth), np.uint8).reshape(rows, bw, depth)
        if one(PREDICTOR, 1) == 2:
            block = block.cumsum(1, dtype=np.uint8)
        out[y : y + rows, x : x + bw, plane : plane + depth] = block
    return out[:height, :width].reshape(height, width * samples)


def pages_of(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a file, in the order of its directories."""
    for tags in directories(data):
        yield decode_page(data, tags)


def payload_of(text: str | None, unit: int) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % unit or (unit if not raw else 0))


def store_texts(docs: DataFrame, width: int = 576, page_rows: int = 1024, compression: str = "deflate", predictor: int = 2, tile: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, media)``: every whole text as the pages of a TIFF, ``width`` samples a row.

    The UTF-8 bytes are filled with 255, which UTF-8 never has, to a positive
    multiple of ``width``.  A null text is stored as an empty one; every row,
    repeated or not, with a null id or not, gives its own file, and equal texts
    equal files.  Long texts fill as many pages as they need.  Other columns,
    whatever their names, are neither read nor returned; an empty table gives
    an empty one.
    """

    def run(batches):
        for batch in batches:
            media, first, held = [], 0, 0
            for k, text in enumerate(batch.column(1), 1):
                samples = np.frombuffer(payload_of(text.as_py(), width), np.uint8).reshape(-1, width)
                media.append(write_tiff([samples[y : y + page_rows] for y in range(0, len(samples), page_rows)], compression, predictor, tile))
                held += len(media[-1])
                if held > HELD or k == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(media)), pa.array(media, pa.binary())], names=[id_col, "media"])
                    media, first, held = [], k, 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def page_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each page: ``(id_col, page, width, height, samples, error)``.

    A null or damaged file gives one row with null samples and the error.  Rows
    with null or equal ids are files of their own; an empty table gives an
    empty one.
    """

    def run(batches):
        for batch in batches:
            for row, data in enumerate(batch.column(1).to_pylist()):
                pages, error = [], None
                try:
                    if data is None:
                        raise ValueError("no file")
                    pages = list(pages_of(data))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    error = str(e)
                n = len(pages) + bool(error)
                width, height, samples = [p.shape[1] for p in pages], [p.shape[0] for p in pages], [p.tobytes() for p in pages]
                pad = [None] * bool(error)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([row] * n, pa.int64())), pa.array(range(n), pa.int32()), pa.array(width + pad, pa.int32()), pa.array(height + pad, pa.int32()), pa.array(samples + pad, pa.binary()), pa.array([None] * len(pages) + [error] * bool(error), pa.string())],
                    names=[id_col, "page", "width", "height", "samples", "error"],
                )

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, page int, width int, height int, samples binary, error string")


def feature(samples: np.ndarray, pages: int) -> str:
    """Page count, mean sample, and an 8-bin histogram in thousandths."""
    bins = np.bincount(samples >> 5, minlength=8)
    return f"pages={pages};mean={samples.mean():.4f};hist=" + ",".join(str(round(1000 * b / len(samples))) for b in bins.tolist())


def digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored bytes of each file hold, read back page by page.

    Files are walked as in :func:`page_rows`, all pages of one where it lies,
    so nothing is shuffled.  A null or damaged file is an error: nothing is
    lost quietly.  Every row, repeated or with a null id, gives its own; an
    empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows = []
                for data in part.column(1).to_pylist():
                    pages = list(pages_of(data))
                    payload = b"".join(p.tobytes() for p in pages)
                    rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, np.uint8), len(pages)), len(pages)))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"])

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    return media.select(id_col, media_col).mapInArrow(run, schema)
