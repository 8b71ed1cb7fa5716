"""Media columns: Netpbm and BMP to numpy, NPY tiles and difference hashes (operator 4).

Images are decoded to numpy arrays, area-resized through integral images (exact
for fractional boxes), hashed by comparing neighbours of a 9 x 8 thumbnail, and
written as one NPY array of tiles an image. The stored form is a binary column
of a Parquet table in a shared folder, written by Spark, so that lost executors
cost only a repeated task.

Defined results: null media gives null outputs; media that can't be decoded
gives nulls and the reason in ``error``; repeated rows and null ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TILE = 24
#: Bytes that a payload is padded to a multiple of: one tile.
UNIT = TILE * TILE
FILL = 255


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    values, at = [], 2
    while len(values) < fields:
        found = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not found:
            raise ValueError("netpbm header")
        values.append(int(found[1]))
        at = found.end()
    return values, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 16-bit samples above a maximum of 255."""
    kind = int(data[1:2])
    bitmap, colour, plain = kind in (1, 4), kind in (3, 6), kind < 4
    values, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height = values[:2]
    most = 1 if bitmap else values[2]
    if not width or not height or not 0 < most < 65536:
        raise ValueError("netpbm size")
    shape = (height, width, 3) if colour else (height, width)
    count = int(np.prod(shape))
    dtype = np.uint8 if most < 256 else np.uint16
    if plain:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        samples = np.frombuffer(re.sub(rb"[^01]", b"", body), np.uint8) - 48 if bitmap else np.array(body.split(), np.int64)
    elif bitmap:
        row = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        samples = np.unpackbits(raw, axis=1)[:, :width].reshape(-1)
    else:
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at + 1)
    if len(samples) < count:
        raise ValueError("netpbm too short")
    out = samples[:count].astype(dtype).reshape(shape)
    return (1 - out) * np.uint8(255) if bitmap else out  # in a bitmap 1 is black


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; grey palettes give (height, width), others (height, width, 3)."""
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head < 40:
        raise ValueError("bmp header")
    width, height, _, bits, packed, _, _, _, colours = struct.unpack_from("<iiHHIIiiI", data, 18)
    if packed not in (0, 3) or width <= 0 or not height or bits not in (1, 4, 8, 24, 32):
        raise ValueError("bmp form")
    rows = abs(height)
    stride = (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = raw[:, :width]
    elif bits == 4:
        index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)[:, :width]
    n = colours or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index]
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither netpbm nor bmp")


def encode_pgm(image: np.ndarray) -> bytes:
    return f"P5\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette."""
    height, width = image.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def integral(image: np.ndarray) -> np.ndarray:
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.float64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=out[1:, 1:])
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of every target pixel's box, edges weighted by the share they cover."""
    table = integral(image)
    for axis, n in ((0, height), (1, width)):
        edge = np.linspace(0, table.shape[axis] - 1, n + 1)
        low = np.minimum(edge.astype(np.int64), table.shape[axis] - 2)
        share = np.expand_dims(edge - low, 1 - axis)
        table = np.take(table, low, axis) * (1 - share) + np.take(table, low + 1, axis) * share
    box = image.shape[0] / height * (image.shape[1] / width)
    return np.diff(np.diff(table, axis=0), axis=1) / box


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is a thumbnail's pixel brighter than its left neighbour."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def to_tiles(image: np.ndarray, tile: int = TILE) -> np.ndarray:
    """(tiles, tile, tile[, 3]) in row order; edges are repeated to fill the last tiles."""
    pad = [(0, -image.shape[0] % tile), (0, -image.shape[1] % tile)] + [(0, 0)] * (image.ndim - 2)
    full = np.pad(image, pad, "edge")
    rows, columns = full.shape[0] // tile, full.shape[1] // tile
    return full.reshape(rows, tile, columns, tile, *full.shape[2:]).swapaxes(1, 2).reshape(-1, tile, tile, *full.shape[2:])


def from_tiles(tiles: np.ndarray, height: int, width: int) -> np.ndarray:
    tile = tiles.shape[1]
    rows, columns = -(-height // tile), -(-width // tile)
    full = tiles.reshape(rows, columns, tile, tile, *tiles.shape[3:]).swapaxes(1, 2).reshape(rows * tile, columns * tile, *tiles.shape[3:])
    return full[:height, :width]


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tile_media(df: DataFrame, id_col: str, media_col: str, tile: int = TILE) -> DataFrame:
    """id, height, width, npy (tiles) and error of every media value."""
    schema = "id long, height int, width int, npy binary, error string"

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out = []
                for data in batch.column(1).to_pylist():
                    try:
                        image = None if data is None else decode(data)
                        out.append((None,) * 4 if image is None else (*image.shape[:2], npy_bytes(to_tiles(image, tile)), None))
                    except (ValueError, IndexError, struct.error) as error:
                        out.append((None, None, None, str(error)))
                yield _batch([("height", pa.int32()), ("width", pa.int32()), ("npy", pa.binary()), ("error", pa.string())], out, batch.column(0))

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(tiles, schema)


def read_tiles(stored: DataFrame) -> DataFrame:
    """id, samples (bytes of the image in row order), npy and dhash, from what is stored."""
    schema = "id long, samples binary, npy binary, dhash string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out = []
                for height, width, npy in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
                    if npy is None:
                        out.append((None,) * 3)
                        continue
                    image = from_tiles(np.load(io.BytesIO(npy), allow_pickle=False), height, width)
                    out.append((image.tobytes(), npy, difference_hash(image)))
                yield _batch([("samples", pa.binary()), ("npy", pa.binary()), ("dhash", pa.string())], out, batch.column(0))

    return stored.select("id", "height", "width", "npy").mapInArrow(read, schema)


def _batch(kinds: list[tuple[str, pa.DataType]], rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], names=["id", *(n for n, _ in kinds)])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media: every text's bytes, filled to whole tiles, as a grey image one tile wide.

    Half of the texts (by checksum) make a PGM and half a BMP file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.row_slices(whole, 1, 4 << 20):
                offsets, data = common.utf8_buffers(batch.column(1))
                out = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    size = max(1, -(-int(b - a) // UNIT)) * UNIT
                    payload = np.full(size, FILL, np.uint8)
                    payload[: b - a] = data[a:b]
                    image = payload.reshape(-1, TILE)
                    out.append(((encode_bmp if zlib.crc32(payload) & 1 else encode_pgm)(image),))
                yield _batch([("media", pa.binary())], out, batch.column(0))

    return common.id_and_text(docs, id_col, text_col).mapInArrow(encode, "id long, media binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4 over all documents; the length of a text is what precedes the filling (byte 255 is in no UTF-8 text)."""
    docs = common.read_table(spark, sf_dir, "documents")
    stored = common.materialize(tile_media(text_media(docs), "id", "media"), "tiles")
    unpadded = F.length(F.rtrim(F.decode("samples", "ISO-8859-1"), F.lit(chr(FILL))))
    return read_tiles(stored).select(
        F.col("id").alias("doc_id"), unpadded.cast("long").alias("n_bytes"), F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"), F.length("npy").cast("long").alias("media_bytes"), F.sha2("npy", 256).alias("media_sha256"), F.col("dhash").alias("feature"),
    )
