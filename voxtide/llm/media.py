"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, and kept as NPY tiles with
difference hashes.

Decoding is a narrow pass, one image at a time; no row is shuffled. ``store_texts`` writes any texts
losslessly as 8-bit RGB images, made by DataFrame functions alone, to a media table in the shared folder.

Defined cases: null bytes, or bytes that aren't an image of these formats, give a null array, hash and tile and the
reason in ``error``; a null text is an empty one (one row of spaces); a null doc_id is kept as such; a very long text makes one tall
image; an empty table gives an empty result; repeated rows get equal results. Other columns are handed on, but ``tiles`` raises
ValueError if one has the name of a column that it adds.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import gives_back, stored

#: Pixels of a row of a text's image, of three samples each.
WIDTH = 64
TILE = 8
#: Samples of a strip of the integral image.
STRIP = 1 << 16
GREY = np.array([0.299, 0.587, 0.114])


def as_netpbm(text: Column) -> tuple[Column, Column]:
    """(number of UTF-8 bytes, PPM bytes): the text followed by spaces up to a positive multiple of a row."""
    body, row = F.coalesce(text, F.lit("")), 3 * WIDTH
    n = F.octet_length(body)
    rows = F.greatest(F.lit(1), F.ceil(n / row)).cast("int")
    image = F.concat(F.format_string(f"P6\n{WIDTH} %d\n255\n", rows), body, F.repeat(F.lit(" "), rows * row - n))
    return n.cast("long"), image.cast("binary")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written media table (doc_id, n_bytes, media), as it reads back."""
    n, image = as_netpbm(F.col(text_col))
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n_bytes"), image.alias("media")), "media", "zstd")


_COMMENT = re.compile(rb"#[^\r\n]*")


def _fields(data: bytes, n: int) -> tuple[list[int], int]:
    """The next n numbers of a Netpbm header (after its magic), and the place after the one white space that ends it."""
    found, at = [], 2
    while len(found) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = _COMMENT.match(data, at).end() if data[at] == 35 else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def _scaled(samples: np.ndarray, most: int, top: int) -> np.ndarray:
    """Samples of 0 to ``most`` as 0 to ``top``, rounded; those that use the whole range stay as they are."""
    if samples.size and int(samples.max()) > most:
        raise ValueError("a sample above the image's maximum")
    return samples if most == top else ((samples.astype(np.int64) * top + most // 2) // most).astype(samples.dtype)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as height x width x samples, scaled to the whole range of 8 or 16 bits; bitmaps as 0 (black) and 255."""
    kind = data[1] - 48
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not a Netpbm image")
    head, at = _fields(data, 2 if kind in (1, 4) else 3)
    (width, height), most = head[:2], head[2] if len(head) > 2 else 1
    if not 1 <= most <= 65535:
        raise ValueError("a maximum out of range")
    depth = 3 if kind in (3, 6) else 1
    if kind == 4:
        line = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at).reshape(height, line), axis=1)[:, :width]
        return ((1 - bits) * 255)[:, :, None].astype(np.uint8)
    plain = _COMMENT.sub(b" ", data[at - 1 :]) if kind <= 3 else b""
    if kind == 1:
        bits = np.array([c - 48 for c in plain if c in b"01"][: width * height], np.uint8)
        return ((1 - bits) * 255).reshape(height, width, 1).astype(np.uint8)
    wide, top = (np.dtype(">u2"), 65535) if most > 255 else (np.dtype(np.uint8), 255)
    if kind > 3:
        return _scaled(np.frombuffer(data, wide, width * height * depth, at), most, top).reshape(height, width, depth)
    samples = np.array(plain.split()[: width * height * depth], np.int64)
    return _scaled(samples, most, top).astype(wide).reshape(height, width, depth)


def _by_mask(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The samples under a bit mask, scaled to 8 bits."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return (((pixels.astype(np.uint64) & np.uint64(mask)) >> np.uint64(low)) * np.uint64(255) // np.uint64(most)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP, of the 12-byte header or a later one, as height x width x 3, in RGB: 1, 4 and 8 bits by palette, 16 and 32 bits by
    masks (the usual ones if none are given), 24 bits."""
    start, header = struct.unpack_from("<II", data, 10)
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    if header == 12:
        (width, height, _, bits), packed, entry, colours = struct.unpack_from("<HHHH", data, 18), 0, 3, 0
    else:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        entry, colours = 4, struct.unpack_from("<I", data, 46)[0]
    if packed not in (0, 3, 6) or packed and bits not in (16, 32) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0:
        raise ValueError("not an uncompressed BMP image")
    line = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)
    if bits <= 8:
        colours = min(colours or 1 << bits, (start - 14 - header) // entry)
        palette = np.frombuffer(data, np.uint8, entry * colours, 14 + header).reshape(-1, entry)
        index = rows if bits == 8 else np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits) @ (1 << np.arange(bits)[::-1])
        image = palette[index[:, :width]][:, :, 2::-1]
    elif bits == 24:
        image = rows[:, : 3 * width].reshape(len(rows), width, 3)[:, :, 2::-1]
    else:
        usual = (0x7C00, 0x03E0, 0x001F) if bits == 16 else (0xFF0000, 0x00FF00, 0x0000FF)
        masks = struct.unpack_from("<III", data, 54) if packed else usual
        pixels = rows[:, : width * bits // 8].copy().view("<u2" if bits == 16 else "<u4")
        image = np.stack([_by_mask(pixels, m) for m in masks], axis=2)
    return image if height < 0 else image[::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _corners(length: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of equal parts of a length: the whole place before each (never the last), and how far past it the edge lies."""
    edges = np.linspace(0, length, parts + 1)
    low = np.minimum(edges.astype(int), length - 1)
    return low, edges - low


def area_resize(image: np.ndarray, height: int, width: int, mix: np.ndarray | None = None) -> np.ndarray:
    """Mean of each target pixel's exact area: the integral image is read, between its points linearly, at the areas' corners.

    Only strips of the integral image are made, as only the lines at the corners are read: beside the image, some ``STRIP`` samples
    are held, or one line of its shorter side. ``mix`` weighs the samples of a pixel into one.
    """
    if image.shape[1] > image.shape[0]:
        return area_resize(image.transpose(1, 0, 2), width, height, mix).transpose(1, 0, 2)
    (low, share), (left, rest) = _corners(image.shape[0], height), _corners(image.shape[1], width)
    share, rest = share[:, None, None], rest[None, :, None]
    depth = image.shape[2] if mix is None else 1
    step = max(1, STRIP // (image.shape[1] * image.shape[2]))
    corners, above = np.zeros((height + 1, width + 1, depth)), np.zeros((width + 1, depth))
    for top in range(0, image.shape[0], step):
        strip = image[top : top + step] if mix is None else (image[top : top + step] @ mix)[:, :, None]
        integral = np.zeros((strip.shape[0] + 1, strip.shape[1] + 1, depth))
        np.cumsum(strip, axis=0, dtype=np.float64, out=integral[1:, 1:])
        np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
        lines = above + integral[:, left] * (1 - rest) + integral[:, left + 1] * rest
        here = np.flatnonzero((low >= top) & (low < top + strip.shape[0]))
        corners[here] = lines[low[here] - top] * (1 - share[here]) + lines[low[here] - top + 1] * share[here]
        above = lines[-1]
    return np.diff(np.diff(corners, axis=0), axis=1) / (image.shape[0] / height * image.shape[1] / width)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 areas is darker than the one on its right."""
    small = area_resize(image[:, :, :1] if image.shape[2] != 3 else image, 8, 9, GREY if image.shape[2] == 3 else None)[:, :, 0]
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    top = 65535 if image.dtype.itemsize > 1 else 255
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, top).astype(np.uint16 if top > 255 else np.uint8))
    return out.getvalue()


def tiles(media: DataFrame, media_col: str = "media", side: int = TILE) -> DataFrame:
    """``media`` with its bytes replaced by what decoding them gives: media_bytes, media_sha256, height, width, samples_bytes,
    samples_sha256, tail_crc32 (of the last 16 sample bytes), dhash, tile (NPY) and error."""
    place = media.columns.index(media_col)
    names = ["media_bytes", "media_sha256", "height", "width", "samples_bytes", "samples_sha256", "tail_crc32", "dhash", "tile", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    rest = [c for c in media.columns if c != media_col]
    if clash := set(rest) & set(names):
        raise ValueError(f"columns that tiles() adds are there already: {sorted(clash)}")

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 9 + ("no bytes",)
        known = len(data), hashlib.sha256(data).hexdigest()
        try:
            image = decode(data)
            if not image.size:
                raise ValueError("an image without pixels")
        except (ValueError, IndexError, OverflowError, struct.error) as error:
            return *known, *(None,) * 7, str(error)[:200]
        samples = np.ascontiguousarray(image).reshape(-1).view(np.uint8)
        return *known, *image.shape[:2], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), difference_hash(image), npy_tile(image, side), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [one(x.as_py()) for x in batch.column(place)]
                kept = [c for i, c in enumerate(batch.columns) if i != place]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=rest + names)

    added = "media_bytes long, media_sha256 string, height long, width long, samples_bytes long, samples_sha256 string, tail_crc32 long, dhash string, tile binary, error string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != media_col), added])
    return media.mapInArrow(gives_back(run), schema)
