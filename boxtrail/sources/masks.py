"""Label masks: TIFF images in which each pixel holds the number of the object it belongs to, read as boxes and written from boxes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the TIFF format: tags, letters of the types of numbers, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, SIZES, PREDICTOR, TILE = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322
NUMBERS = {1: "B", 3: "H", 4: "I"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
BOXES = "sequence string, frame long, track_id long, x double, y double, w double, h double"


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 empties the table, 257 ends the strip. Codes grow one entry before the table needs it."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, before, out = list(first), 9, b"", bytearray()
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("damaged LZW strip")
        word = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + word[:1])
        out += word
        before = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


UNPACK = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def decode(data: bytes) -> np.ndarray:
    """The first channel of the first image, rows by columns. Strips of 8, 16 or 32 bits; tiles and other depths raise ValueError."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF image")
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        here = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(order + "HHI", data, here)
        if kind in NUMBERS:
            form = f"{order}{n}{NUMBERS[kind]}"
            start = here + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, here + 8)[0]
            tags[tag] = struct.unpack_from(form, data, start)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, depth, samples = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(SAMPLES, 1)
    if TILE in tags or depth not in (8, 16, 32) or one(COMPRESSION, PLAIN) not in UNPACK or OFFSETS not in tags:
        raise ValueError("only strips of 8, 16 or 32 bits are read, plain, LZW, deflated or packed")
    strips = [UNPACK[one(COMPRESSION, PLAIN)](data[o : o + n]) for o, n in zip(tags[OFFSETS], tags[SIZES], strict=True)]
    step = one(ROWS, height) * width * samples * depth // 8  # a strip may be padded
    raw = b"".join(s[:step] for s in strips)[: height * width * samples * depth // 8]
    pixels = np.frombuffer(raw, np.dtype(f"{order}u{depth // 8}")).reshape(height, width, samples)
    if one(PREDICTOR, 1) == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=pixels.dtype.newbyteorder("="))
    return pixels[..., 0]


def encode(mask: np.ndarray) -> bytes:
    """A deflated TIFF of one strip, of 16 bits, or of 32 where a label needs them."""
    kind = "<u2" if mask.max(initial=0) < 1 << 16 else "<u4"
    strip = zlib.compress(mask.astype(kind).tobytes())
    values = [(WIDTH, mask.shape[1]), (HEIGHT, mask.shape[0]), (BITS, 8 * int(kind[-1])), (COMPRESSION, DEFLATE), (262, 1), (OFFSETS, 8), (SAMPLES, 1), (ROWS, mask.shape[0]), (SIZES, len(strip))]
    entries = b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in values)
    pad = len(strip) % 2
    return b"II*\0" + struct.pack("<I", 8 + len(strip) + pad) + strip + b"\0" * pad + struct.pack("<H", len(values)) + entries + b"\0\0\0\0"


def tight_boxes(mask: np.ndarray) -> np.ndarray:
    """(label, x, y, w, h) of each label above 0, by label."""
    ys, xs = np.nonzero(mask)
    labels = mask[ys, xs].astype(np.int64)
    order = np.argsort(labels, kind="stable")
    labels, xs, ys = labels[order], xs[order], ys[order]
    if not len(labels):
        return np.empty((0, 5), np.int64)
    start = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    x, y = np.minimum.reduceat(xs, start), np.minimum.reduceat(ys, start)
    return np.column_stack([labels[start], x, y, np.maximum.reduceat(xs, start) - x + 1, np.maximum.reduceat(ys, start) - y + 1])


def mask_boxes(images: DataFrame) -> DataFrame:
    """The boxes of images (path, content): one row for each label of each image. The frame is the number at the end of the file's name, from 0, plus 1 (files
    without one are passed over), the sequence the folder two above the file without _GT, else the folder of the file. An image that can't be read raises."""
    parts = F.split("path", "/")
    name, above, folder = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2))
    number = F.regexp_extract(name, r"([0-9]+)(?:\.[^.]*)?$", 1)
    sequence = F.coalesce(F.nullif(F.regexp_replace(above, "_GT$", ""), F.lit("")), folder)
    rows = images.where(number != "").select(sequence.alias("sequence"), (number.cast("long") + 1).alias("frame"), "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples():
                try:
                    found.append(tight_boxes(decode(bytes(r.content))))
                except (ValueError, KeyError, TypeError, struct.error, zlib.error) as bad:
                    raise ValueError(f"unreadable mask {r.path}: {bad}") from bad
            if found:
                n, b = [len(f) for f in found], np.concatenate(found)
                yield pd.DataFrame({"sequence": np.repeat(pdf.sequence.to_numpy(), n), "frame": np.repeat(pdf.frame.to_numpy(), n), "track_id": b[:, 0], "x": b[:, 1], "y": b[:, 2], "w": b[:, 3], "h": b[:, 4]})

    return rows.mapInPandas(run, BOXES)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """mask_boxes() of all man_track*.tif below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "man_track*.tif").option("recursiveFileLookup", "true").load(path)
    return mask_boxes(files.select("path", "content"))


def paint(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Images (path, content) of boxes (sequence, frame, track_id from 1, x, y, w, h in whole pixels), later tracks over earlier ones; a frame is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), np.uint32)
        for r in pdf.sort_values("track_id").itertuples():
            mask[max(0, int(r.y)) : max(0, int(r.y + r.h)), max(0, int(r.x)) : max(0, int(r.x + r.w))] = r.track_id
        return pd.DataFrame({"path": [f"{pdf.sequence.iloc[0]}_GT/TRA/man_track{pdf.frame.iloc[0] - 1:03d}.tif"], "content": [encode(mask)]})

    return boxes.select("sequence", "frame", "track_id", "x", "y", "w", "h").groupBy("sequence", "frame").applyInPandas(run, "path string, content binary")
