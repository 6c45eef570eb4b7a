"""Byte payloads as lossless PNG images in binary columns, and cosine-transform hashes of them.

`store_media` writes, `read_media` reads: the bytes are stored as 8-bit grey
samples in zlib-compressed chunks with checksums, tested and unfiltered on the
way back. Each row is stored by the filter that leaves the least absolute
differences, and many images are filtered and unfiltered together, the latter
along diagonals, where no sample depends on another. The hash keeps the signs of the low frequencies of a two-dimensional
cosine transform, taken of the mean 24 x 24 tile.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.words import free_memory

TILE = 24
#: Samples in an image row; a payload is padded to a multiple of it.
WIDTH = TILE * TILE
FILL = 255
LOW = 8
LEVEL = 6
IDAT_BYTES = 1 << 20
#: Bytes of images that are filtered together.
LOT_BYTES = 1 << 20
#: Fixed value: the first bytes of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def pad(data: bytes, width: int = WIDTH, fill: int = FILL) -> bytes:
    """`data` up to the next positive multiple of `width`."""
    return data + bytes([fill]) * (max(-(-len(data) // width), 1) * width - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, filter_type: int | None = None, level: int = LEVEL) -> bytes:
    """An 8-bit grey PNG with `payload`'s bytes as samples, row by row; each row by its best filter, if none is given."""
    return encode_all([payload], width, filter_type, level)[0]


def encode_all(payloads: list[bytes], width: int = WIDTH, filter_type: int | None = None, level: int = LEVEL) -> list[bytes]:
    """A PNG for each payload. Their rows are filtered together."""
    if any(not p or len(p) % width for p in payloads):
        raise ValueError(f"a payload is a positive multiple of {width} bytes")
    heights = np.array([len(p) // width for p in payloads], np.int64)
    starts = np.cumsum(heights) - heights
    rows = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width), starts, filter_type)
    return [_file(rows[at : at + n], width, level) for at, n in zip(starts.tolist(), heights.tolist(), strict=True)]


def _file(rows: np.ndarray, width: int, level: int) -> bytes:
    packed = zlib.compress(rows.tobytes(), level)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    parts = [packed[i : i + IDAT_BYTES] for i in range(0, len(packed), IDAT_BYTES)]
    return SIGNATURE + _chunk(b"IHDR", header) + b"".join(_chunk(b"IDAT", x) for x in parts) + _chunk(b"IEND", b"")


def filtered(image: np.ndarray, starts: np.ndarray, filter_type: int | None = None) -> np.ndarray:
    """Rows of samples with their filter type before them; images start at the rows `starts`.

    Without a type each row takes the one whose differences, as signed bytes, have the
    least sum of absolute values; the first of equal ones.
    """
    rows = np.empty((len(image), image.shape[1] + 1), np.uint8)
    least = np.full(len(image), np.iinfo(np.int64).max)
    for kind in range(PAETH + 1) if filter_type is None else [filter_type]:
        left = image - _predicted(image, kind, starts)
        total = np.minimum(left, -left).sum(1, dtype=np.int64)
        better = total < least
        least[better] = total[better]
        rows[better, 0] = kind
        rows[better, 1:] = left[better]
    return rows


def _predicted(image: np.ndarray, filter_type: int, starts: np.ndarray | int = 0) -> np.ndarray:
    left, up, corner = np.zeros_like(image), np.zeros_like(image), np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    up[1:] = image[:-1]
    up[starts] = 0
    corner[:, 1:] = up[:, :-1]
    if filter_type == AVERAGE:
        return ((left.astype(np.int16) + up) // 2).astype(np.uint8)
    if filter_type == PAETH:
        return _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)
    return {NONE: np.zeros_like(image), SUB: left, UP: up}[filter_type]


def _paeth(left, up, corner):
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def unfilter(rows: np.ndarray, width: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Samples from filtered rows (filter type, then `width` bytes), one byte a sample; images start at the rows `starts`.

    A sample needs those on its left, above and between, so all samples on a diagonal
    (column plus row of the image) are undone in one step, for all images at once.
    """
    kinds, raw = rows[:, 0], rows[:, 1:]
    if (kinds > PAETH).any():
        raise ValueError("unknown filter type")
    starts = np.zeros(1, np.int64) if starts is None else starts
    y = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
    order = np.argsort(y, kind="stable")  # rows at work in one step are then a run of these
    y, kinds = y[order], kinds[order]
    step = width + 1
    out = np.zeros((len(rows) + 1) * step, np.int16)  # a blank column goes before each row, and a blank row after all
    place = order * step + 1
    above = np.where(y > 0, place - step, len(rows) * step + 1)
    flat = np.zeros((len(rows), width), np.uint8)
    flat[:] = raw
    flat = flat.ravel()
    source = order * width
    for d in range(width + int(y[-1]) if len(y) else 0):
        low, high = np.searchsorted(y, (d - width, d), "right")
        x = d - y[low:high]
        here, over = place[low:high] + x, above[low:high] + x
        left, up, corner = out[here - 1], out[over], out[over - 1]
        guess = np.choose(kinds[low:high], (0, left, up, (left + up) >> 1, _paeth(left, up, corner)))
        out[here] = (flat[source[low:high] + x] + guess) & 255
    return out[: len(rows) * step].reshape(-1, step)[:, 1:].astype(np.uint8)


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG. Raises ValueError if a signature, checksum, length or form is wrong."""
    rows = png_rows(media)
    return unfilter(rows, rows.shape[1] - 1)


def png_rows(media: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit grey PNG, all checksums tested. Raises ValueError as decode_png."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (length,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if at + 12 + length > len(media) or struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum or length is wrong")
        if kind == b"IHDR":
            if len(body) != 13:
                raise ValueError("a header's length is wrong")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a complete 8-bit grey image")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(packed))  # tests the stream's own checksum
    except zlib.error as error:
        raise ValueError(str(error)) from error
    if not width or len(raw) != height * (width + 1):
        raise ValueError("the samples don't fill the image")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if (rows[:, 0] > PAETH).any():
        raise ValueError("unknown filter type")
    return rows


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(TILE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * TILE))


def cosine_hash(payload: np.ndarray) -> str:
    """64 bits in hex: which low frequencies of the mean tile exceed the median of all but the constant one."""
    tile = payload.reshape(-1, TILE, TILE).mean(0)
    low = np.round(_cosines() @ tile @ _cosines().T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _lots(sizes: list[int], most: int = LOT_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most `most` bytes together; a larger one is a run of its own."""
    low, total = 0, 0
    for i, size in enumerate(sizes):
        if i > low and total + size > most:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_type: int | None = None) -> DataFrame:
    """doc_id, n_bytes and the binary column `media`: each text's UTF-8 bytes, padded, as a PNG of filtered rows.

    A null text is an empty one: one image row of padding. Equal texts give equal
    images. Ids may be null or repeat; other columns are ignored; an empty table stays empty.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for low, high in _lots([len(x) for x in texts]):
                part = texts[low:high]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(part)),
                        pa.array([len(x) for x in part], pa.int64()),
                        pa.array(encode_all([pad(x) for x in part], filter_type=filter_type), pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "media"],
                )
        free_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _decoded(media: list[bytes | None]) -> list[np.ndarray | str]:
    """The samples of each image, or what is wrong with it; images of one width are unfiltered together."""
    found: list[np.ndarray | str] = []
    for m in media:
        try:
            found.append("no image" if m is None else png_rows(m))
        except ValueError as error:
            found.append(str(error))
    widths = {x.shape[1] for x in found if not isinstance(x, str)}
    for width in widths:
        own = [i for i, x in enumerate(found) if not isinstance(x, str) and x.shape[1] == width]
        heights = np.array([len(found[i]) for i in own], np.int64)
        starts = np.cumsum(heights) - heights
        samples = unfilter(np.concatenate([found[i] for i in own]), width - 1, starts)
        for i, at, n in zip(own, starts.tolist(), heights.tolist(), strict=True):
            found[i] = samples[at : at + n]
    return found


def read_media(stored: DataFrame) -> DataFrame:
    """Reads `media` back (doc_id, n_bytes, media): digests of payload and image, and the hash `feature`.

    A null or damaged image gives nulls and its `error`; the job goes on.
    """

    def describe(media: bytes | None, payload: np.ndarray | str) -> tuple:
        if media is None:
            return (None, None, None, None, None, None, payload)
        size, digest = len(media), hashlib.sha256(media).hexdigest()
        if isinstance(payload, str):
            return (None, None, None, size, digest, None, payload)
        data = payload.tobytes()
        feature = cosine_hash(payload) if payload.size and payload.size % WIDTH == 0 else None
        return (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), size, digest, feature, None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            media = batch.column(2).to_pylist()
            for low, high in _lots([len(m or b"") for m in media], LOT_BYTES // 3):  # texts shrink to about a third
                part = media[low:high]
                found = [describe(m, p) for m, p in zip(part, _decoded(part), strict=True)]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                ids = [batch.column(c).slice(low, high - low) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *columns], ["doc_id", "n_bytes", *names])
        free_memory()

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id {kind}, n_bytes long, {FEATURES}")
