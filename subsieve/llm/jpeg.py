"""Media columns: baseline JPEG with the payload in the DC coefficients of 8 x 8 luminance blocks.

A payload byte is one block's mean (its sample value), so the image at an eighth of its size is the payload again, 24
samples wide. Writing is lossless: the DC quantiser is 8, which makes a coefficient a whole sample value, and there are
no AC coefficients. The Huffman tables are the usual ones for luminance. A payload too large for one image goes on in
the next one.

Reading decodes any baseline scan: other tables, AC coefficients, several components and restarts. numpy looks up the
code that would begin at every bit of a window of the scan, which says where a block (or unit of blocks) that begins at
this bit would end; those jumps, doubled a few times, are followed from the scan's first bit.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty

UNIT = 576  # payloads are padded with bytes 255 to a positive multiple of this
ACROSS = 24  # blocks in a row of an image that encode() writes
IMAGE = UNIT * 340  # payload bytes in an image at most; JPEG's height ends at 65535
_OUT_BYTES = 8 << 20

# The luminance tables of ITU-T T.81, annex K (codes of 1 to 16 bits, symbols in order of their codes).
_DC_LENGTHS = bytes.fromhex("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00")
_DC_SYMBOLS = bytes(range(12))
_AC_LENGTHS = bytes.fromhex("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d")
_AC_SYMBOLS = bytes.fromhex(
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0"
    "24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49"
    "4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89"
    "8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5"
    "c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8"
    "f9 fa"
)
_END_OF_BLOCK = 0
_WINDOW = 1 << 12  # bytes of a scan that are looked at together; more where a unit is longer
_DOUBLINGS = 3
_NO_CODE = 1 << 29  # as many bits on is behind any window


class Codes:
    """A Huffman table by the next 16 bits: bits of the code (0: there is none) and its symbol."""

    def __init__(self, lengths: bytes, symbols: bytes):
        bits = np.repeat(np.arange(1, 17), list(lengths))
        shares = 1 << 16 - bits
        n = int(shares.sum())
        if n > 1 << 16 or len(bits) != len(symbols):
            raise ValueError("no Huffman table")
        self.bits, self.symbol = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.bits[:n] = np.repeat(bits, shares)
        self.symbol[:n] = np.repeat(np.frombuffer(symbols, np.uint8), shares)
        known = self.bits > 0
        ends = self.symbol == _END_OF_BLOCK
        # bits of a DC code with its number, of an AC code with its number, of an end of block alone
        self.dc = np.where(known & (self.symbol < 16), self.bits + self.symbol, _NO_CODE).astype(np.int64)
        self.ac = np.where(known, self.bits + (self.symbol & 15), _NO_CODE).astype(np.int64)
        self.end = np.where(known & ends, self.bits, _NO_CODE).astype(np.int64)
        self.gain = np.where(known & ~ends, (self.symbol >> 4) + 1, 64).astype(np.uint8)  # coefficients an AC code stands for

    def code(self, symbol: int) -> tuple[int, int]:
        """(code, its bits) of a symbol."""
        first = int(np.flatnonzero((self.symbol == symbol) & (self.bits > 0))[0])
        return first >> 16 - int(self.bits[first]), int(self.bits[first])


codes = lru_cache(64)(Codes)


def padded(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT)


def _block_bits() -> tuple[np.ndarray, np.ndarray]:
    """The bits of a block, and their number, by its difference to the block before, from -255 to 255."""
    dc, (end, end_bits) = codes(_DC_LENGTHS, _DC_SYMBOLS), codes(_AC_LENGTHS, _AC_SYMBOLS).code(_END_OF_BLOCK)
    value, bits = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = dc.code(s)
        value[d + 255] = (code << s | (d if d > 0 else d + (1 << s) - 1)) << end_bits | end
        bits[d + 255] = n + s + end_bits
    return value, bits


_BLOCK, _BLOCK_BITS = _block_bits()


def _packed(values: np.ndarray, bits: np.ndarray) -> bytes:
    """Values of up to 25 bits one after the other, filled up with ones."""
    ends = bits.cumsum()
    starts = ends - bits
    words = values << (32 - (starts & 7) - bits).astype(np.uint32)
    n = -(-int(ends[-1]) // 8)
    out = sum(np.bincount((starts >> 3) + i, words >> 24 - 8 * i & 255, n + 4) for i in range(4))[:n].astype(np.uint8)  # no two share a bit
    out[-1] |= (1 << -int(ends[-1]) % 8) - 1
    return out.tobytes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_image(samples: bytes) -> bytes:
    """A grey image with a block for each sample; their number is a multiple of ACROSS and at most IMAGE."""
    rows = len(samples) // ACROSS
    v = np.frombuffer(samples, np.uint8).astype(np.int16)
    step = np.diff(v, prepend=np.int16(128)) + 255
    scan = _packed(_BLOCK[step], _BLOCK_BITS[step])
    return b"".join((
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), _segment(0xDB, b"\0" + b"\x08" + b"\x01" * 63),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + b"\x01\x11\0"),
        _segment(0xC4, b"\0" + _DC_LENGTHS + _DC_SYMBOLS), _segment(0xC4, b"\x10" + _AC_LENGTHS + _AC_SYMBOLS),
        _segment(0xDA, b"\x01\x01\0\0\x3f\0"), scan.replace(b"\xff", b"\xff\0"), b"\xff\xd9",
    ))


def encode_payload(payload: bytes) -> bytes:
    return b"".join(encode_image(payload[i : i + IMAGE]) for i in range(0, len(payload), IMAGE))


def thumbnails(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, DC-only luminance thumbnail) of each image in a row of baseline JPEG images.

    The thumbnail has a sample for each luminance block that the image needs. Raises ValueError for what isn't baseline JPEG.
    """
    out, at = [], 0
    while at < len(media):
        image, at = _image(media, at)
        out.append(image)
    return out


_END_OF_SCAN = re.compile(rb"\xff+[^\0\xd0-\xd7\xff]")


def _image(media: bytes, at: int) -> tuple[tuple[int, int, np.ndarray], int]:
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    at += 2
    quant, tables, frame, restart, found = {}, {}, None, 0, None
    while True:
        while media[at : at + 2] == b"\xff\xff":
            at += 1
        if len(media) < at + 2 or media[at] != 0xFF:
            raise ValueError("no marker")
        marker, at = media[at + 1], at + 2
        if marker == 0xD9:
            if found is None:
                raise ValueError("an image without a scan")
            return found, at
        size = int.from_bytes(media[at : at + 2], "big")
        body, at = media[at + 2 : at + size], at + size
        if size < 2 or len(body) != size - 2:
            raise ValueError("a cut segment")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # of the DC coefficient
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("samples aren't 8 bits")
            frame = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline image")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            end = _END_OF_SCAN.search(media, at)
            if not end:
                raise ValueError("a cut scan")
            data, at = media[at : end.start()], end.end() - 2
            ids = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            if frame[2][0][0] in ids:  # the first component is luminance
                found = (frame[0], frame[1], _luminance(data, frame, ids, quant, tables, restart))


def _luminance(data: bytes, frame, ids, quant, tables, restart: int) -> np.ndarray:
    width, height, components = frame
    first = components[0]
    rows, columns = -(-height // 8), -(-width // 8)
    coefficients = _coefficients(data, frame, ids, tables, restart)[:rows, :columns]
    # a sample is the mean of its block: the coefficient by its quantiser, over 8, around 128
    return np.clip((coefficients.astype(np.int32) * quant[first[3]] + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def _next_bits(raw: np.ndarray) -> np.ndarray:
    """The 16 bits that begin at each bit of raw, at its end and one further; behind the end are zeros."""
    r = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
    words = r[:-2] << 16 | r[1:-1] << 8 | r[2:]
    return (words[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).astype(np.intp).ravel()[: 8 * len(raw) + 2]


def _ahead(length: np.ndarray, bits: np.ndarray, at: np.ndarray, beyond: int) -> np.ndarray:
    to = length[bits]
    to += at
    return np.minimum(to, beyond, out=to)


def _block_ends(bits: np.ndarray, dc: Codes, ac: Codes, with_ac: bool) -> np.ndarray:
    """Where the block that begins at each bit ends; the last position stands for behind the window and for no code.

    Without `with_ac` blocks with AC coefficients count as no code. With it an end is found from jumps over 1, 2, 4 to 32
    AC codes: as many as leave the block open, and one more.
    """
    at = np.arange(len(bits))
    beyond = len(bits) - 1
    if with_ac:
        jump, gain = [_ahead(ac.ac, bits, at, beyond)], [ac.gain[bits]]
        for _ in range(5):
            gain.append(np.minimum(gain[-1] + gain[-1][jump[-1]], 64).astype(np.uint8))
            jump.append(jump[-1][jump[-1]])
        end, k = at, np.zeros(len(bits), np.uint8)
        for j, g in zip(reversed(jump), reversed(gain), strict=True):
            more = k + g[end]
            is_open = more < 63
            k, end = np.where(is_open, more, k), np.where(is_open, j[end], end)
        end = jump[0][end]
    else:
        end = _ahead(ac.end, bits, at, beyond)
    return end[_ahead(dc.dc, bits, at, beyond)]


def _followed(step: np.ndarray, start: int, n: int) -> np.ndarray:
    """start, step[start] and so on: n jumps or as many as stay in the window, the last position not included."""
    jumps = [step]
    for _ in range(_DOUBLINGS):
        jumps.append(jumps[-1][jumps[-1]])
    far, beyond = jumps.pop(), len(step) - 1
    marks = [start]
    while marks[-1] != beyond and len(marks) << _DOUBLINGS <= n:
        marks.append(int(far[marks[-1]]))
    found = np.array(marks)
    for j in reversed(jumps):
        found = np.stack([found, j[found]], 1).ravel()
    return found[: n + 1][found[: n + 1] != beyond]


def _differences(bits: np.ndarray, dc: Codes, starts: np.ndarray) -> np.ndarray:
    """The numbers of the DC codes that begin at starts."""
    code = bits[starts]
    s = dc.symbol[code]
    v = bits[starts + dc.bits[code]] >> 16 - s
    return np.where(v < 1 << s >> 1, v - (1 << s) + 1, v)


def _units(data: bytes, n: int, unit: list[tuple[Codes, Codes, bool]]) -> np.ndarray:
    """DC differences of the wanted blocks of n units: a row for each unit, whose blocks are (DC, AC table, wanted)."""
    raw = np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)
    out, at, window, with_ac = [], 0, _WINDOW, False
    while n:
        begin = at >> 3
        bits = _next_bits(raw[begin : begin + window])
        ends = {}
        for dc, ac, _ in unit:
            if (dc, ac) not in ends:
                ends[dc, ac] = _block_ends(bits, dc, ac, with_ac)
        step = ends[unit[0][:2]]
        for dc, ac, _ in unit[1:]:
            step = ends[dc, ac][step]
        found = _followed(step, at & 7, n)
        if len(found) < 2:  # no unit ends here: it has AC coefficients, is longer than the window, or isn't one
            if with_ac and begin + window >= len(raw):
                raise ValueError("a cut scan or no such code")
            window, with_ac = window * 2 if with_ac else window, True
            continue
        starts, columns = found[:-1], []
        for dc, ac, wanted in unit:
            if wanted:
                columns.append(_differences(bits, dc, starts))
            starts = ends[dc, ac][starts]
        out.append(np.stack(columns, 1))
        n, at = n - len(found) + 1, 8 * begin + int(found[-1])
    return np.concatenate(out)


def _coefficients(data: bytes, frame, ids, tables, restart: int) -> np.ndarray:
    """DC coefficients of the first component; each restart interval is read on its own."""
    width, height, components = frame
    used = [c for c in components if c[0] in ids]
    most = [max(c[i] for c in components) for i in (1, 2)]
    if len(used) == 1:  # blocks come in the component's own order
        c = used[0]
        across, down = (-(-(-(-size * c[i] // most[i - 1])) // 8) for i, size in ((1, width), (2, height)))
        shape = [(c, 1, 1)]
    else:
        across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
        shape = [(c, c[1], c[2]) for c in used]
    if any(d not in tables or 0x10 | a not in tables for d, a in ids.values()):
        raise ValueError("a scan without its tables")
    unit = [(codes(*tables[ids[c[0]][0]]), codes(*tables[0x10 | ids[c[0]][1]]), c is used[0]) for c, h, v in shape for _ in range(h * v)]
    _, h, v = shape[0]
    left, values = across * down, []
    for part in re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]:
        if n := min(restart or left, left):
            values.append(_units(part, n, unit).ravel().cumsum(dtype=np.int64))
            left -= n
    if left:
        raise ValueError("a cut scan")
    values = np.concatenate(values) if values else np.zeros(0, np.int64)
    return values.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)


def difference_hash(thumbnail: np.ndarray) -> str:
    """64 bits: of a 8 x 9 grid of cell means, whether each is below its right neighbour."""
    rows = np.linspace(0, thumbnail.shape[0], 9).astype(int)
    columns = np.linspace(0, thumbnail.shape[1], 10).astype(int)
    total = np.pad(thumbnail.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cells = total[rows[1:]][:, columns[1:]] - total[rows[:-1]][:, columns[1:]] - total[rows[1:]][:, columns[:-1]] + total[rows[:-1]][:, columns[:-1]]
    means = cells / np.maximum(np.outer(np.diff(rows), np.diff(columns)), 1)
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


def _out(schema: pa.Schema, rows):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= _OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of docs (doc_id, text): its padded UTF-8 bytes as JPEG images.

    Null text is empty (one image of padding); null doc_ids and repeated rows come back each; empty table: no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        yield from _out(schema, ((i, len(data := t.encode()), encode_payload(padded(data))) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, media_bytes, media_sha256, width, height, images, thumbnail_hash) of stored media.

    payload: the samples of all thumbnails; width of the first image, height of all of them. Images of one width have one
    hash, as one image; else each has its own, joined by commas. Null media: nulls.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("images", pa.int64()), ("thumbnail_hash", pa.string())])

    def read(i, n, data):
        if data is None:
            return (i, n, *[None] * 7)
        found = thumbnails(data)
        small = [np.vstack([t for *_, t in found])] if len({w for w, *_ in found}) == 1 else [t for *_, t in found]
        return i, n, b"".join(t.tobytes() for *_, t in found), len(data), hashlib.sha256(data).hexdigest(), found[0][0], sum(h for _, h, _ in found), len(found), ",".join(map(difference_hash, small))

    def run(batches):
        yield from _out(schema, (read(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, width long, height long, images long, thumbnail_hash string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = from_media(to_media(table(spark, sf_dir, "documents")))
    return d.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "images", "thumbnail_hash").alias("feature"),
    )
