"""Media columns: GIF images as timed frames with colour histograms.

A decoder of the GIF format in full: LZW code streams with their growing code widths
and clear codes, global and local palettes, interlacing, transparency, and the disposal
of each frame before the next. A frame is stored as it is shown: the whole canvas in
RGBA, its time, and a histogram of its opaque colours in 64 bins (4 levels of red, green
and blue each).

Defined results: a null image, an empty one, one that isn't a GIF, that breaks off or
that declares more than MAX_PIXELS gives the frames up to there and then one row with
the reason as `error`; a GIF without frames gives no row; a missing delay is 0 ms;
repeated rows give repeated results; columns other than the two named are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canvas pixels that an image may declare.
MAX_PIXELS = 1 << 26
_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


class Frame(NamedTuple):
    """What is drawn: indices into a palette at a place, and how."""

    pixels: np.ndarray  # height x width
    left: int = 0
    top: int = 0
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None  # n x 3, else the global one
    interlaced: bool = False


class BadGif(ValueError):
    """The image can't be read further."""


def _code_runs(data: bytes, width: int) -> Iterator[list[int]]:
    """The codes between clear codes, up to the stop code or the data's end.

    A code's width follows from its number since the last clear code alone, as each but the first adds an entry to the table; so
    thousands of codes are cut out of the bytes at once.
    """
    clear, stop, total = 1 << width, (1 << width) + 1, 8 * len(data)
    d = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    p = k = 0
    run: list[int] = []
    while True:
        m = min(4096, max(1, (total - p) // (width + 1)))
        entries = clear + 2 + np.maximum(np.arange(k, k + m) - 1, 0)
        bits = np.clip(np.searchsorted(_SIZES, entries, "right"), width + 1, 12)
        at = p + np.cumsum(bits) - bits
        at = at[at + bits <= total]
        bits = bits[: len(at)]
        i = at >> 3
        codes = ((d[i] | d[i + 1] << 8 | d[i + 2] << 16) >> (at & 7).astype(np.uint32)) & ((1 << bits) - 1).astype(np.uint32)
        special = np.flatnonzero((codes == clear) | (codes == stop))
        if not len(special):
            run += codes.tolist()
            k += len(codes)
            if not len(codes) or int(at[-1] + bits[-1]) + width + 1 > total:
                yield run
                return
            p = int(at[-1] + bits[-1])
            continue
        j = int(special[0])
        run += codes[:j].tolist()
        yield run
        if codes[j] == stop:
            return
        p, k, run = int(at[j] + bits[j]), 0, []


_SIZES = 1 << np.arange(13)


def unpack_lzw(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n indices of a code stream that starts with codes of width + 1 bits."""
    clear = 1 << width
    single = [bytes([i]) for i in range(clear)] + [b"", b""]
    size, out = 0, []
    for run in _code_runs(data, width):
        table, last = single.copy(), None
        for code in run:
            if last is None:
                if code >= clear:
                    raise BadGif("code before any other")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise BadGif("code out of order")
                if len(table) < 4096:
                    table.append(last + entry[:1])
            out.append(entry)
            size += len(entry)
            last = entry
            if size >= n:
                return _filled(out, size, n)
    return _filled(out, size, n)


def _filled(out: list[bytes], size: int, n: int) -> np.ndarray:
    if size < n:
        raise BadGif("image data breaks off")
    return np.frombuffer(b"".join(out), np.uint8)[:n]


def pack_lzw(indices: bytes, width: int) -> bytes:
    clear = 1 << width
    table, bits, following = {bytes([i]): i for i in range(clear)}, width + 1, clear + 2
    acc, have, out, run = clear, bits, bytearray(), b""

    def flush():
        nonlocal acc, have
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8

    for i in indices:
        longer = run + bytes([i])
        if longer in table:
            run = longer
            continue
        acc |= table[run] << have
        have += bits
        flush()
        table[longer] = following
        if following == 1 << bits:
            bits += 1
        following += 1
        if following > 4095:
            acc |= clear << have
            have += bits
            table, bits, following = {bytes([i]): i for i in range(clear)}, width + 1, clear + 2
        run = bytes([i])
    if run:
        acc |= table[run] << have
        have += bits
        following += 1
        if following > 1 << bits and bits < 12:
            bits += 1
    acc |= (clear + 1) << have
    have += bits + 7
    flush()
    return bytes(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _depth(palette: np.ndarray) -> int:
    return max(0, int(len(palette) - 1).bit_length() - 1)


def encode(width: int, height: int, palette: np.ndarray, frames: list[Frame], background: int = 0) -> bytes:
    """A GIF of the frames; for tests and for tables that have no images of their own."""

    def colours(p: np.ndarray) -> bytes:
        return np.concatenate((p, np.zeros(((2 << _depth(p)) - len(p), 3), np.uint8))).astype(np.uint8).tobytes()

    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | _depth(palette), background, 0), colours(palette)]
    for f in frames:
        h, w = f.pixels.shape
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0) + b"\0")
        local = f.palette is not None
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, local << 7 | f.interlaced << 6 | (_depth(f.palette) if local else 0)))
        if local:
            out.append(colours(f.palette))
        rows = np.concatenate([np.arange(a, h, s) for a, s in _PASSES]) if f.interlaced else np.arange(h)
        bits = max(2, _depth(f.palette if local else palette) + 1)
        out.append(bytes([bits]) + _blocks(pack_lzw(f.pixels[rows].astype(np.uint8).tobytes(), bits)))
    return b"".join(out) + b"\x3b"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise BadGif("file breaks off")
        return self.data[self.at - n : self.at]

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)

    def palette(self, packed: int) -> np.ndarray | None:
        if not packed & 0x80:
            return None
        return np.frombuffer(self.take(3 * (2 << (packed & 7))), np.uint8).reshape(-1, 3)


def decode(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(delay in ms, canvas as height x width x 4) of each frame as it is shown. Raises BadGif where reading ends early."""
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise BadGif("not a GIF")
    width, height, packed, _, _ = struct.unpack("<HHBBB", r.take(7))
    if width * height > MAX_PIXELS:
        raise BadGif("canvas too large")
    shared = r.palette(packed)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while True:
        kind = r.take(1)
        if kind == b"\x3b":
            return
        if kind == b"\x21":
            label, body = r.take(1), r.blocks()
            if label == b"\xf9" and len(body) >= 4:
                flags, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else None
            continue
        if kind != b"\x2c":
            raise BadGif("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", r.take(9))
        palette = r.palette(flags)
        palette = shared if palette is None else palette
        if palette is None:
            raise BadGif("no palette")
        if w * h > MAX_PIXELS:
            raise BadGif("frame too large")
        bits = r.take(1)[0]
        if not 1 <= bits <= 8:
            raise BadGif("code width")
        indices = unpack_lzw(r.blocks(), bits, w * h).reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in _PASSES])
            straight = np.empty_like(indices)
            straight[rows] = indices
            indices = straight
        full = np.zeros((256, 4), np.uint8)
        full[: len(palette), :3] = palette
        full[:, 3] = 255  # indices beyond the palette are black
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        shown = indices[: part.shape[0], : part.shape[1]]
        drawn = np.ones(shown.shape, bool) if transparent is None else shown != transparent
        part[drawn] = full[shown[drawn]]
        yield delay * 10, canvas.copy()
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    c = canvas[canvas[..., 3] > 0][:, :3].astype(np.int64) >> 6
    return np.bincount(c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2], minlength=64)


FRAMES = "id long, frame int, start_ms long, delay_ms int, width int, height int, rgba binary, histogram array<int>, transparent int, error string"
_SCHEMA = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int32())), ("transparent", pa.int32()), ("error", pa.string())])


def _rows(image_id, data: bytes | None):
    n = start = 0
    try:
        if not data:
            raise BadGif("no image")
        for delay, canvas in decode(bytes(data)):
            yield image_id, n, start, delay, canvas.shape[1], canvas.shape[0], canvas.tobytes(), histogram(canvas).tolist(), int((canvas[..., 3] == 0).sum()), None
            n, start = n + 1, start + delay
    except BadGif as e:
        yield image_id, n, start, None, None, None, None, None, None, str(e)


def frames(images: DataFrame, id_column: str = "id", gif_column: str = "gif") -> DataFrame:
    """A row for each frame of each GIF, or for why reading ended; a map without a shuffle."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for i, data in zip(batch.column("id").to_pylist(), batch.column("gif").to_pylist()):
                for row in _rows(i, data):
                    out.append(row)
                    size += len(row[6] or b"")
                    if size > 1 << 23:
                        yield _batch(out)
                        out, size = [], 0
            if out:
                yield _batch(out)

    return images.select(F.col(id_column).cast("long").alias("id"), F.col(gif_column).alias("gif")).mapInArrow(run, FRAMES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def thumbnails(vectors: DataFrame) -> DataFrame:
    """(id, gif): an animation of three frames for each vector, since no table here has images.

    The vector as grey levels on a square canvas; its upper half, transparent where values are negative, taken away
    afterwards; and the whole again, interlaced, under a palette of its own.
    """
    schema = pa.schema([("id", pa.int64()), ("gif", pa.binary())])
    grey = np.repeat(np.arange(0, 256, 4, dtype=np.uint8)[:, None], 3, axis=1)
    warm = np.stack([grey[:, 0], grey[:, 0] // 2, 255 - grey[:, 0]], axis=1)

    def draw(v: list | None) -> bytes | None:
        if not v:
            return None
        x = np.nan_to_num(np.array([c or 0 for c in v], float))
        side = int(np.ceil(np.sqrt(len(x))))
        level = np.zeros(side * side, np.uint8)
        level[: len(x)] = np.clip(32 + x * 31 / max(np.abs(x).max(), 1e-9), 1, 63).astype(np.uint8)
        level = level.reshape(side, side)
        half = np.where(level[: side // 2 + 1] < 32, 0, level[: side // 2 + 1])
        return encode(side, side, grey, [Frame(level, delay=10, disposal=1), Frame(half, delay=20, disposal=2, transparent=0), Frame(level, delay=5, palette=warm, interlaced=True)])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([draw(v) for v in part.column("v").to_pylist()], pa.binary())], schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).mapInArrow(run, "id long, gif binary")
