"""Media columns: TIFF.

``decode_pages`` walks the image directories of a TIFF file, decodes PackBits, LZW or
deflate strips and tiles, undoes the horizontal predictor and yields one page for each
directory. ``encode`` writes the same layouts, so that texts can be stored as 8-bit
samples and read back. A page holds at most ``PAGE_ROWS`` rows, which bounds the work on
one page however long the payload is.

Tag numbers, field types and code values below are those of the TIFF 6.0 specification.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

# Fixed values of the format.
WIDTH_TAG, HEIGHT_TAG, BITS_TAG, COMPRESSION_TAG, PHOTOMETRIC_TAG = 256, 257, 258, 259, 262
STRIP_OFFSETS_TAG, SAMPLES_TAG, ROWS_PER_STRIP_TAG, STRIP_BYTES_TAG, PREDICTOR_TAG = 273, 277, 278, 279, 317
TILE_WIDTH_TAG, TILE_HEIGHT_TAG, TILE_OFFSETS_TAG, TILE_BYTES_TAG = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
OLD_DEFLATE = 32946
CLEAR_CODE, END_CODE = 256, 257
FIELD = {1: "B", 3: "H", 4: "L"}
FILL_ORDER_TAG, PLANAR_TAG, FORMAT_TAG = 266, 284, 339
#: Each byte with its bits the other way round.
FLIPPED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8)[:, ::-1], axis=1).ravel()
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

WIDTH = 192
#: Rows of a page, a multiple of the strip and tile heights.
PAGE_ROWS = 1024
STRIP_ROWS = 32
TILE_SIDE = 64
#: Pixels of a page, strip or tile that are read; a header that claims more is an error.
MOST_PIXELS = 1 << 28


class TiffError(ValueError):
    """The bytes are not a TIFF file of the kinds that are read here."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    compression: int
    predictor: int
    tiled: bool
    samples: bytes
    channels: int = 1
    bits: int = 8


def packbits(data: bytes, width: int) -> bytes:
    """PackBits code of rows of ``width`` bytes: runs of three or more equal bytes, and literals between them; none crosses a row."""
    a = np.frombuffer(data, np.uint8)
    edge = np.ones(len(a) + 1, bool)
    edge[1:-1] = a[1:] != a[:-1]
    edge[::width] = True
    edge = np.flatnonzero(edge)
    size = np.diff(edge)
    long = size >= 3
    out, todo = bytearray(), list(zip(edge[:-1][long].tolist(), size[long].tolist(), strict=True))[::-1]

    def literal(lo: int, hi: int) -> None:
        for at in range(lo, hi, 128):
            end = min(at + 128, hi)
            out.append(end - at - 1)
            out.extend(data[at:end])

    for done in range(0, len(data), width):
        stop = done + width
        while todo and todo[-1][0] < stop:
            at, n = todo.pop()
            literal(done, at)
            done = at + n
            while n > 1:
                part = min(n, 128)
                out += bytes((257 - part, data[at]))
                n -= part
            if n:
                out += bytes((0, data[at]))
        literal(done, stop)
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


#: Width of the k-th code after a clear: it grows one code early, up to twelve bits.
CODE_WIDTH = np.array([min((END_CODE + 1 + k).bit_length(), 12) for k in range(4096)], np.int64)
CODE_PLACE = np.r_[0, np.cumsum(CODE_WIDTH)]
SINGLES = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw(data: bytes) -> bytes:
    """LZW with the most significant bit first; code width grows one code early.

    A string of the table is its prefix's code and its last byte in one number. Codes are gathered
    first: where a code stands after a clear is its width, so all are put into bits at once.
    """
    if not data:
        return codes_in_bits([CLEAR_CODE, END_CODE])
    codes, table = [CLEAR_CODE], {}
    add, find, next_code, prefix = codes.append, table.get, END_CODE + 1, data[0]
    for byte in data[1:]:
        key = prefix << 8 | byte
        code = find(key)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        table[key] = next_code
        next_code += 1
        if next_code == 4095:
            add(CLEAR_CODE)
            table.clear()
            next_code = END_CODE + 1
        prefix = byte
    return codes_in_bits([*codes, prefix, END_CODE])


def codes_in_bits(codes: list[int]) -> bytes:
    """Codes from a clear on as bits; the first one has nine."""
    code = np.array(codes, np.uint16)
    clear = np.flatnonzero(code == CLEAR_CODE)
    place = np.arange(len(code)) - np.repeat(clear, np.diff(np.r_[clear, len(code)])) - 1
    after = np.repeat(np.diff(np.r_[0, clear])[: len(clear)], np.diff(np.r_[clear, len(code)]))
    place = np.where(place < 0, after - 1, place)  # a clear is the last code of the table before it
    width = CODE_WIDTH[np.maximum(place, 0)]
    bits = np.unpackbits(code.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


def code_runs(data: bytes) -> Iterator[list[int]]:
    """The codes of an LZW stream up to each clear or the end; widths follow from their places, so a run is read at once."""
    raw, at, end = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64), 0, 8 * len(data)
    while True:
        run: list[int] = []
        special = -1
        while special < 0:
            first = min(len(run), 4095)
            places = at + (CODE_PLACE[first:-1] - CODE_PLACE[first] if first < 4095 else 12 * np.arange(4096))
            width = CODE_WIDTH[first:] if first < 4095 else np.full(4096, 12)
            count = int(np.searchsorted(places + width[: len(places)], end, "right"))
            if not count:
                yield run
                return
            places, width = places[:count], width[:count]
            byte = places >> 3
            code = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (places & 7) - width) & (1 << width) - 1
            marks = np.flatnonzero((code == CLEAR_CODE) | (code == END_CODE))
            stop = int(marks[0]) if len(marks) else count
            run += code[:stop].tolist()
            at = int(places[stop] + width[stop]) if len(marks) else int(places[-1] + width[-1])
            special = int(code[stop]) if len(marks) else -1
        yield run
        if special == END_CODE:
            return


def unlzw(data: bytes, size: int) -> bytes:
    out, length = [], 0
    for run in code_runs(data):
        if not run:
            continue
        if run[0] > END_CODE:
            raise TiffError("LZW code out of range")
        table = [*SINGLES]
        last = table[run[0]]
        add, put = table.append, out.append
        put(last)
        length += len(last)
        for code in run[1:]:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            put(word)
            length += len(word)
            if length >= size:
                break
            add(last + word[:1])
            last = word
        if length >= size:
            break
    return b"".join(out)[:size]


def pack(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
    raw = block.tobytes()
    if compression == LZW:
        return lzw(raw)
    if compression == DEFLATE:
        return zlib.compress(raw, 6)
    if compression == PACKBITS:
        return packbits(raw, block.shape[1])
    return raw


def unpack(data: bytes, rows: int, width: int, compression: int, predictor: int, channels: int = 1, kind: str = "u1", flipped: bool = False) -> np.ndarray:
    """Samples of a strip or tile by row, pixel and channel. ``kind``: their type and byte order; ``flipped``: the first bit of a byte is its least."""
    size = rows * width * channels
    if not 0 < size <= MOST_PIXELS:
        raise TiffError("a strip or tile has no pixels or too many")
    size *= np.dtype(kind).itemsize
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not read")
    if flipped:
        data = FLIPPED[np.frombuffer(data, np.uint8)].tobytes()
    if compression == LZW:
        raw = unlzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(data, size)
    elif compression == PACKBITS:
        raw = unpackbits(data, size)
    elif compression == NONE:
        raw = data
    else:
        raise TiffError(f"compression {compression} is not read")
    if len(raw) < size:
        raise TiffError("a strip or tile is too short")
    block = np.frombuffer(raw[:size], kind).reshape(rows, width, channels).astype(np.dtype(kind).newbyteorder("<"))
    if predictor == 2:
        block = np.cumsum(block, axis=1, dtype=block.dtype)
    return block


def encode(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tiled: bool = False) -> bytes:
    """A TIFF file of ``payload``, whose length is a positive multiple of WIDTH, as pages of 8-bit samples."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = bytearray(struct.pack("<2sHL", b"II", 42, 0))
    link = 4
    for top in range(0, len(image), PAGE_ROWS):
        page = image[top : top + PAGE_ROWS]
        blocks = []
        if tiled:
            for y in range(0, len(page), TILE_SIDE):
                for x in range(0, WIDTH, TILE_SIDE):
                    tile = np.zeros((TILE_SIDE, TILE_SIDE), np.uint8)
                    part = page[y : y + TILE_SIDE, x : x + TILE_SIDE]
                    tile[: len(part)] = part
                    blocks.append(pack(tile, compression, predictor))
        else:
            blocks = [pack(page[y : y + STRIP_ROWS], compression, predictor) for y in range(0, len(page), STRIP_ROWS)]
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b + b"\0" * (len(b) & 1)
        sizes = [len(b) for b in blocks]
        fields = [(WIDTH_TAG, 4, [WIDTH]), (HEIGHT_TAG, 4, [len(page)]), (BITS_TAG, 3, [8]), (COMPRESSION_TAG, 3, [compression]), (PHOTOMETRIC_TAG, 3, [1]), (SAMPLES_TAG, 3, [1]), (PREDICTOR_TAG, 3, [predictor])]
        if tiled:
            fields += [(TILE_WIDTH_TAG, 3, [TILE_SIDE]), (TILE_HEIGHT_TAG, 3, [TILE_SIDE]), (TILE_OFFSETS_TAG, 4, offsets), (TILE_BYTES_TAG, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS_TAG, 4, offsets), (ROWS_PER_STRIP_TAG, 3, [STRIP_ROWS]), (STRIP_BYTES_TAG, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(body) > 4:
                body, at = struct.pack("<L", len(out)), body
                out += at
            entries += struct.pack("<HHL4s", tag, kind, len(values), body)
        struct.pack_into("<L", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += struct.pack("<L", 0)
    return bytes(out)


def decode_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file of samples of 8 or 16 bits, in the order of its directories.

    Samples stand by row, pixel and channel, those of 16 bits with the low byte first, whether the file holds its channels
    together or apart; grey where white is zero is turned, so that black is.
    """
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "L", data, 4)
    seen, number = set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("a directory is repeated or out of the file")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            where = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHL", data, where)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                where += 8
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(order + "L", data, where)
                tags[tag] = struct.unpack_from(form, data, where)
        (at,) = struct.unpack_from(order + "L", data, at + 2 + 12 * n)

        def one(tag: int, default: int, tags: dict = tags) -> int:
            return (tags.get(tag) or (default,))[0]

        width, height = one(WIDTH_TAG, 0), one(HEIGHT_TAG, 0)
        compression, predictor = one(COMPRESSION_TAG, NONE), one(PREDICTOR_TAG, 1)
        channels, bits, photometric = one(SAMPLES_TAG, 1), set(tags.get(BITS_TAG) or (1,)), one(PHOTOMETRIC_TAG, 1)
        if bits not in ({8}, {16}) or not 0 < channels <= 64 or one(FORMAT_TAG, 1) != 1 or photometric not in (0, 1, 2, 5):
            raise TiffError("only samples of 8 or 16 bits, grey or of separate colours, are read")
        if not 0 < width * height * channels <= MOST_PIXELS:
            raise TiffError("a page has no pixels or too many")
        kind = "u1" if bits == {8} else f"{order}u2"
        planes = channels if one(PLANAR_TAG, 1) == 2 else 1
        each, flipped = channels // planes, one(FILL_ORDER_TAG, 1) == 2
        image = np.zeros((height, width, channels), np.dtype(kind).newbyteorder("<"))
        if tiled := TILE_OFFSETS_TAG in tags:
            tw, th = one(TILE_WIDTH_TAG, 0), one(TILE_HEIGHT_TAG, 0)
            across = -(-width // tw)
            count = across * -(-height // th)
            if len(tags[TILE_OFFSETS_TAG]) < count * planes:
                raise TiffError("tiles are missing")
            for k, (o, size) in enumerate(zip(tags[TILE_OFFSETS_TAG], tags[TILE_BYTES_TAG], strict=True)):
                plane, at_tile = divmod(k, count) if planes > 1 else (0, k)
                y, x = at_tile // across * th, at_tile % across * tw
                block = unpack(data[o : o + size], th, tw, compression, predictor, each, kind, flipped)
                part = image[y : y + th, x : x + tw, plane * each : (plane + 1) * each]
                part[:] = block[: part.shape[0], : part.shape[1]]
        else:
            step = one(ROWS_PER_STRIP_TAG, height)
            count = -(-height // step)
            if len(tags[STRIP_OFFSETS_TAG]) < count * planes:
                raise TiffError("strips are missing")
            for k, (o, size) in enumerate(zip(tags[STRIP_OFFSETS_TAG], tags[STRIP_BYTES_TAG], strict=True)):
                plane, strip = divmod(k, count) if planes > 1 else (0, k)
                rows = min(step, height - strip * step)
                image[strip * step : strip * step + rows, :, plane * each : (plane + 1) * each] = unpack(data[o : o + size], rows, width, compression, predictor, each, kind, flipped)
        if photometric == 0:
            image = ~image
        yield Page(number, width, height, compression, predictor, tiled, image.tobytes(), channels, max(bits))
        number += 1


def layout_for(payload: bytes) -> tuple[int, int, bool]:
    """Compression, predictor and tiling, which only the payload's checksum decides, at every size."""
    crc = zlib.crc32(payload)
    compression = (DEFLATE, PACKBITS, LZW)[(crc >> 8) % 3]  # the predictor goes with the codes that have tables
    return compression, 1 + (crc >> 3 & 1 if compression in (LZW, DEFLATE) else 0), bool(crc >> 4 & 1)


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def pages(df: DataFrame, media_col: str = "media", id_col: str = "id") -> DataFrame:
    """One row for each page of each TIFF file in ``media_col``.

    Columns id, page, width, height, channels, bits, compression, predictor, tiled, samples, error. A null
    file gives no row; bytes that are no readable TIFF give one row with ``error`` set and
    the rest null: cut off files, empty fields, sides over MOST_PIXELS, data that would
    expand beyond its strip or tile, unknown codes. Repeated rows give repeated pages.
    """

    def read(batches):
        for batch in batches:
            out = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    for p in decode_pages(data):
                        out.append((key, p.number, p.width, p.height, p.channels, p.bits, NAMES[p.compression], p.predictor, p.tiled, p.samples, None))
                except (TiffError, struct.error, zlib.error, ValueError, ArithmeticError, LookupError, MemoryError) as e:
                    out.append((key, *[None] * 9, str(e) or type(e).__name__))
                if sum(len(r[9] or b"") for r in out) > 8 << 20:
                    yield as_batch(out)
                    out = []
            yield as_batch(out)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    names = ["id", "page", "width", "height", "channels", "bits", "compression", "predictor", "tiled", "samples", "error"]

    def as_batch(rows):
        return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return chosen.mapInArrow(tidied(read), "id long, page int, width int, height int, channels int, bits int, compression string, predictor int, tiled boolean, samples binary, error string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each whole text as a TIFF file, read it back page by page and describe what was read.

    A null text is empty; an empty text is one row of blanks. Rows are independent, so
    repeated rows, ties and null ids need no rule; equal texts give equal values. Columns:
    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, pages, and media if asked for.
    """

    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, max(1, len(texts)), 1024):
                rows = [describe((t or "").encode()) for t in texts[lo : lo + 1024]]
                cols = [ids[lo : lo + 1024], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
                yield pa.record_batch(cols, names)

    small_batches(docs)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()] + [pa.binary()] * keep_media
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages"] + ["media"] * keep_media
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"
    return chosen.mapInArrow(tidied(work), schema + (", media binary" if keep_media else ""))


def describe(text: bytes) -> tuple:
    """n_bytes, payload_bytes, ... of one text; the sums are over what was read back."""
    compression, predictor, tiled = layout_for(payload := payload_of(text))
    media = encode(payload, compression, predictor, tiled)
    digest, size, total, tail, count, height = sha256(), 0, 0, b"", 0, 0
    histogram = np.zeros(256, np.int64)
    for p in decode_pages(media):
        digest.update(p.samples)
        size += len(p.samples)
        tail = (tail + p.samples)[-16:]
        histogram += np.bincount(np.frombuffer(p.samples, np.uint8), minlength=256)
        count, height = count + 1, height + p.height
    total = int(histogram @ np.arange(256))
    feature = f"{WIDTH}x{height} pages={count} {NAMES[compression]} predictor={predictor} {'tiles' if tiled else 'strips'} levels={int((histogram > 0).sum())} mode={int(histogram.argmax())} sum={total}"
    return len(text), size, digest.hexdigest(), zlib.crc32(tail), len(media), sha256(media).hexdigest(), feature, count, media
