"""Media columns: motion-JPEG in AVI.

Frames are lossless JPEG (SOF3, 8 bits, one component, predictor 1).  The Huffman table gives difference class s a
code of 9 - s bits, so that code and extra bits always make 9 bits: coding and decoding are table look-ups over whole
frames.  Tables read from a file may be any; those without that property are decoded bit by bit.  Ordinary motion-JPEG
frames of other writers (baseline DCT, SOF0, and 8-bit SOF1) are read as well: the samples of their first component, which
is the brightness, at full size.

``encode`` stores payloads, ``decode`` parses the RIFF chunks and idx1, decodes the frames and finds shots where the
difference of neighbouring frames' histograms exceeds mean + ``k`` deviations of the differences in a window around it.

Defined results: null text is empty; an empty payload is stored as 64 zero bytes; equal texts give equal files; repeated
rows and null ids are rows of their own; an empty table gives no rows; other columns are ignored.  A payload must stay
under RIFF's 4 GiB.  ``decode`` also takes other writers' files: every RIFF and AVIX segment is walked, and without a
``strd`` chunk the payload is all frames' bytes; a null or damaged file, or one with frames of another kind (progressive,
arithmetic, 12 bits, coloured lossless ones, frames that leave out their tables and find none in ``tables``), gives a row
with that ``status`` and null features instead of ending the job.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Generator, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 64
WIDTH, HEIGHT, FPS = 64, 16, 25
BINS, RADIUS, SPREAD, FLOOR = 16, 8, 3.0, 0.1
#: Output rows are handed on in batches of about this many media bytes.
BATCH_BYTES = 8 << 20

# Fixed values of the JPEG format: markers.
SOI, EOI, SOF3, DHT, SOS = b"\xff\xd8", b"\xff\xd9", 0xC3, 0xC4, 0xDA
SOF0, SOF1, DQT, DRI = 0xC0, 0xC1, 0xDB, 0xDD


def _code_words() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit word of each difference modulo 256, and back."""
    words, back = np.zeros(256, np.uint16), np.zeros(512, np.uint8)
    for d in range(-128, 128):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        prefix = (1 << (9 - s)) - 2 if s else (1 << 9) - 2
        word = (prefix << s) | extra
        words[d & 255], back[word] = word, d & 255
    return words, back


WORDS, BACK = _code_words()
#: Classes by code length: one of each length from 1 (class 8) to 9 (class 0); the word of nine ones stays unused.
TABLE_COUNTS, TABLE_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def _frames_of(payload: bytes) -> np.ndarray:
    size = WIDTH * HEIGHT
    flat = np.frombuffer(payload, np.uint8)
    if len(flat) % size:
        flat = np.concatenate([flat, np.zeros(-len(flat) % size, np.uint8)])
    return flat.reshape(-1, HEIGHT, WIDTH)


HEAD = (
    SOI
    + b"\xff\xc4" + struct.pack(">HB", 2 + 17 + 9, 0) + TABLE_COUNTS + TABLE_SYMBOLS
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """One JPEG of each (HEIGHT, WIDTH) frame."""
    diff = np.empty_like(frames)
    diff[:, :, 1:] = frames[:, :, 1:] - frames[:, :, :-1]
    diff[:, 1:, 0] = frames[:, 1:, 0] - frames[:, :-1, 0]
    diff[:, 0, 0] = frames[:, 0, 0] - np.uint8(128)
    words = WORDS[diff.reshape(len(frames), -1)]
    groups = words.reshape(-1, 8).astype(np.uint64)
    low = np.zeros(len(groups), np.uint64)  # the last seven words: 63 bits
    for k in range(1, 8):
        low = (low << np.uint64(9)) | groups[:, k]
    first = groups[:, 0]
    packed = np.empty((len(groups), 9), np.uint8)
    packed[:, 0] = (first >> np.uint64(1)).astype(np.uint8)
    packed[:, 1:] = (((first & np.uint64(1)) << np.uint64(63)) | low).astype(">u8").view(np.uint8).reshape(-1, 8)
    rows = packed.reshape(len(frames), -1)
    return [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + EOI for row in rows]


def decode_frame(jpeg: bytes) -> np.ndarray:
    return decode_frames([jpeg])[0]


def decode_frames(jpegs: list[bytes], tables: bytes = b"") -> np.ndarray:
    """Frames of equal size, decoded together where their table has words of one length; ``tables`` as for ``dct_frame``."""
    if any(_frame_kind(j) in (SOF0, SOF1) for j in jpegs):
        return np.stack([dct_frame(j, tables) if _frame_kind(j) in (SOF0, SOF1) else decode_frame(j) for j in jpegs])
    parsed = [_parse(j) for j in jpegs]
    height, width = parsed[0][1]
    if all(p[0] == parsed[0][0] and p[1] == (height, width) for p in parsed) and parsed[0][0] == (TABLE_COUNTS, TABLE_SYMBOLS):
        need = -(-height * width * 9 // 8)
        data = np.frombuffer(b"".join(p[2][:need] for p in parsed), np.uint8)
        if height * width % 8 == 0:
            groups = data.reshape(-1, 9)
            low = np.ascontiguousarray(groups[:, 1:]).view(">u8").ravel().astype(np.uint64)
            words = np.empty((len(groups), 8), np.uint16)
            words[:, 0] = (groups[:, 0].astype(np.uint16) << 1) | (low >> np.uint64(63)).astype(np.uint16)
            for k in range(1, 8):
                words[:, k] = ((low >> np.uint64(63 - 9 * k)) & np.uint64(511)).astype(np.uint16)
            diff = BACK[words].reshape(len(parsed), height, width)
        else:
            diff = np.stack([_slow(p[2], p[0], height * width) for p in parsed]).astype(np.uint8).reshape(-1, height, width)
    else:
        return np.stack([_undo(_slow(d, t, h * w).astype(np.uint8).reshape(1, h, w))[0] for t, (h, w), d in parsed])
    return _undo(diff)


def _undo(diff: np.ndarray) -> np.ndarray:
    out = diff.copy()
    out[:, 0, 0] += np.uint8(128)
    out[:, :, 0] = np.cumsum(out[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(out, axis=2, dtype=np.uint8)


def _parse(jpeg: bytes) -> tuple[tuple[bytes, bytes], tuple[int, int], bytes]:
    """Huffman table, (height, width) and entropy-coded bytes, without stuffing, of a one-component SOF3 image."""
    if jpeg[:2] != SOI:
        raise ValueError("no JPEG")
    at, table, shape = 2, None, None
    while True:
        marker, length = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == DHT:
            n = sum(body[1:17])
            table = (body[1:17], body[17 : 17 + n])
        elif marker == SOF3:
            precision, height, width, parts = struct.unpack(">BHHB", body[:6])
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit images of one component")
            shape = (height, width)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only lossless JPEG frames")
        elif marker == SOS:
            if body[3] != 1:
                raise ValueError("only predictor 1")
            end = jpeg.rindex(EOI)
            return table, shape, jpeg[at:end].replace(b"\xff\x00", b"\xff")


def _slow(data: bytes, table: tuple[bytes, bytes], count: int) -> np.ndarray:
    """Differences decoded bit by bit with any canonical Huffman table."""
    codes, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            codes[(length, code)] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    bits, at, out = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0, []
    for _ in range(count):
        length = code = 0
        while (length, code) not in codes:
            code, length, at = (code << 1) | bits[at], length + 1, at + 1
        s, extra = codes[(length, code)], 0
        for _ in range(s):
            extra, at = (extra << 1) | bits[at], at + 1
        out.append(extra if not s or extra >> (s - 1) else extra - (1 << s) + 1)
    return np.array(out) & 255


# --- DCT frames ----------------------------------------------------------------------------------------------------


def _segments(jpeg: bytes) -> Generator[tuple[int, bytes, int], int | None, None]:
    """(marker, body, where the next segment starts) up to the end; the caller skips entropy-coded bytes by ``send``."""
    at = 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("damaged file")
        marker = jpeg[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == EOI[1]:
            return
        end = at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
        at = (yield marker, jpeg[at + 4 : end], end) or end


def _frame_kind(jpeg: bytes) -> int:
    """The marker of the frame header; 0 where there is none."""
    if jpeg[:2] != SOI:
        return 0
    return next((m for m, _, _ in _segments(jpeg) if 0xC0 <= m <= 0xCF and m not in (DHT, 0xC8, 0xCC)), 0)


#: Places of a block's coefficients in the order of the file: by diagonals, odd ones downwards, even ones upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_WAVE = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) / 2
_WAVE[0] /= np.sqrt(2)
#: The first byte after entropy-coded ones that is neither stuffing nor a restart.
_SCAN_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


@lru_cache(maxsize=64)
def _words(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) of the word that each 16 bits begin with; length 0 where none does."""
    found, code, k = [(0, 0)] * (1 << 16), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << (16 - length)
            found[code * span : (code + 1) * span] = [(length, symbols[k])] * span
            code, k = code + 1, k + 1
        code <<= 1
    if len(found) != 1 << 16:
        raise ValueError("damaged file")
    return found


class _Bits:
    """Bits of one stretch of entropy-coded bytes; behind its end come ones, as in the padding."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data + b"\xff" * 8, 0, 0, 0

    def _fill(self) -> None:
        while self.n < 16:
            part = self.data[self.at : self.at + 6]
            if not part:
                raise ValueError("damaged file")
            self.at += len(part)
            self.held = (self.held & ((1 << self.n) - 1)) << (8 * len(part)) | int.from_bytes(part, "big")
            self.n += 8 * len(part)

    def symbol(self, words: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self._fill()
        length, found = words[(self.held >> (self.n - 16)) & 0xFFFF]
        if not length:
            raise ValueError("damaged file")
        self.n -= length
        return found

    def number(self, size: int) -> int:
        """A signed number of that many bits."""
        if not size:
            return 0
        if size > 15:
            raise ValueError("damaged file")
        if self.n < size:
            self._fill()
        self.n -= size
        value = (self.held >> self.n) & ((1 << size) - 1)
        return value if value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, dc: list, ac: list, before: int, out: np.ndarray) -> int:
    """One block's coefficients into ``out``, in the order of the file; its mean, to which the next one is relative."""
    mean = before + bits.number(bits.symbol(dc))
    if abs(mean) >= 1 << 15:
        raise ValueError("damaged file")
    out[0], k = mean, 1
    while k < 64:
        run = bits.symbol(ac)
        if run == 0:
            break
        k += run >> 4
        if run & 15:
            if k > 63:
                raise ValueError("damaged file")
            out[k] = bits.number(run & 15)
        k += 1
    return mean


def dct_frame(jpeg: bytes, tables: bytes = b"") -> np.ndarray:
    """The first component's samples, (height, width), of a baseline DCT image.

    Any sampling factors, restarts and one or several scans are read.  ``tables`` is a JPEG stream of tables (SOI, DHT
    and DQT, EOI) for writers whose frames leave theirs out.
    """
    words, scales, parts, shape, every = {}, {}, {}, None, 0
    for stream in (tables, jpeg) if tables else (jpeg,):
        segments, skip = _segments(stream), None
        while True:
            try:
                marker, body, at = segments.send(skip)
            except StopIteration:
                break
            skip = None
            if marker == DHT:
                while body:
                    n = sum(body[1:17])
                    words[body[0]] = _words(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == DQT:
                while body:
                    wide = body[0] >> 4
                    scales[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[65 + 64 * wide :]
            elif marker == DRI:
                every = int.from_bytes(body[:2], "big")
            elif marker in (SOF0, SOF1):
                precision, height, width, n = struct.unpack(">BHHB", body[:6])
                if precision != 8 or not height or not width:
                    raise ValueError("only 8-bit images of a stated size")
                sizes = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
                wide, high = max(s[0] for s in sizes.values()), max(s[1] for s in sizes.values())
                across, down = -(-width // (8 * wide)), -(-height // (8 * high))
                shape, first = (height, width), body[6]
                if across * down * sum(h * v for h, v, _ in sizes.values()) > 4 * len(stream):  # a block takes two bits at least
                    raise ValueError("damaged file")
                for name, (h, v, q) in sizes.items():
                    if not 1 <= h <= 4 or not 1 <= v <= 4:
                        raise ValueError("damaged file")
                    parts[name] = (h, v, q, np.zeros((down * v, across * h, 64), np.int32))
            elif marker == SOS:
                if shape is None:
                    raise ValueError("damaged file")
                end = _SCAN_END.search(stream, at)
                skip = end.start() if end else len(stream)
                named = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                if any(t >> 4 not in words or 16 + (t & 15) not in words for _, t in named):
                    raise ValueError("frames leave out their tables")
                _scan(stream[at:skip], [(*parts[c], words[t >> 4], words[16 + (t & 15)]) for c, t in named], every, (across, down), shape, (wide, high))
    if shape is None:
        raise ValueError("no JPEG")
    h, v, q, blocks = parts[first]
    if q not in scales:
        raise ValueError("frames leave out their tables")
    plain = np.zeros(blocks.shape, np.float64)
    plain[..., ZIGZAG] = blocks * scales[q]
    plain = plain.reshape(*blocks.shape[:2], 8, 8)
    samples = np.einsum("ua,ijuv,vb->iajb", _WAVE, plain, _WAVE, optimize=True).reshape(blocks.shape[0] * 8, -1)
    samples = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8)
    rows, columns = np.arange(shape[0]) * v // high, np.arange(shape[1]) * h // wide  # a smaller component is spread
    return samples[rows][:, columns]


def _scan(data: bytes, parts: list, every: int, units: tuple[int, int], shape: tuple[int, int], most: tuple[int, int]) -> None:
    """Fill the blocks of the scan's components; each stretch between restarts begins anew."""
    if len(parts) == 1:  # its own blocks in order, without those that only fill up a unit
        h, v = parts[0][:2]
        across, down = (-(-(-(-size * f // m)) // 8) for size, f, m in ((shape[1], h, most[0]), (shape[0], v, most[1])))
        places = [[(0, i, j)] for i in range(down) for j in range(across)]
    else:
        cells = [(k, i, j) for k, part in enumerate(parts) for i in range(part[1]) for j in range(part[0])]
        places = [[(k, y * parts[k][1] + i, x * parts[k][0] + j) for k, i, j in cells] for y in range(units[1]) for x in range(units[0])]
    every = every or len(places)
    stretches = _RESTART.split(data)
    if len(stretches) < -(-len(places) // every):
        raise ValueError("damaged file")
    for n in range(0, len(places), every):
        bits, before = _Bits(stretches[n // every].replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for unit in places[n : n + every]:
            for k, i, j in unit:
                _, _, _, blocks, dc, ac = parts[k]
                before[k] = _block(bits, dc, ac, before[k], blocks[i, j])


# --- files ---------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """The AVI file of a padded payload; ``strd`` keeps the payload's length, as the last frame may be padded."""
    jpegs = encode_frames(_frames_of(payload))
    n, biggest = len(jpegs), max(map(len, jpegs))
    avih = struct.pack("<14I", 1_000_000 // FPS, biggest * FPS, 0, 0x10, n, 0, 1, biggest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, biggest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    stream = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload))))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + stream)
    chunks, index, at = [], [], 4
    for jpeg in jpegs:
        chunks.append(_chunk(b"00dc", jpeg))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        at += len(chunks[-1])
    body = b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames' JPEGs by idx1 (or by the movi list, where it is absent), frames a second, the payload's length if given."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    todo = [(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))]  # a stack, as lists may be nested to any depth
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            follows = at + 8 + n + n % 2
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                found[kind] = (at + 8, n)
                if kind != b"movi":
                    todo.append((follows, end))
                    at, end = at + 12, min(end, at + 8 + n)
                    continue
            else:
                found.setdefault(name, (at + 8, n))
            at = follows
    scale, rate = struct.unpack_from("<II", data, found[b"strh"][0] + 20)
    length = struct.unpack_from("<Q", data, found[b"strd"][0])[0] if b"strd" in found else None
    movi, movi_length = found[b"movi"]
    jpegs = []

    def frames(at: int, end: int) -> None:
        todo = [(at, end)]
        while todo:
            at, end = todo.pop()
            while at + 8 <= end:
                n = int.from_bytes(data[at + 4 : at + 8], "little")
                follows = at + 8 + n + n % 2
                if data[at : at + 4] == b"LIST":
                    todo.append((follows, end))
                    at, end = at + 12, min(end, at + 8 + n)
                    continue
                if data[at + 2 : at + 4] in (b"dc", b"db"):
                    jpegs.append(data[at + 8 : at + 8 + n])
                at = follows

    if b"idx1" in found:
        at, n = found[b"idx1"]
        for name, _, offset, size in struct.iter_unpack("<4sIII", data[at : at + n - n % 16]):
            if name[2:] in (b"dc", b"db"):
                start = movi + offset if data[movi + offset : movi + offset + 4] == name else offset
                jpegs.append(data[start + 8 : start + 8 + size])
    else:
        frames(movi + 4, movi + movi_length)
    at = 8 + int.from_bytes(data[4:8], "little")
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] == b"AVIX":  # later segments have no idx1
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        frames(at + 12, min(len(data), at + 8 + n))
        at += 8 + n + n % 2
    return jpegs, rate / scale if scale else float(FPS), length


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot: a cut is wherever the histogram difference exceeds an adaptive bound."""
    n = len(frames)
    if n < 2:
        return [(0, n)]
    flat = frames.reshape(n, -1)
    bins = (flat >> 4).astype(np.int64) + (np.arange(n) * BINS)[:, None]
    hist = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS) / flat.shape[1]
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (diff, diff * diff))
    at = np.arange(len(diff))
    low, high = np.maximum(at - RADIUS, 0), np.minimum(at + RADIUS + 1, len(diff))
    others = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - diff) / others
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - diff * diff) / others - mean * mean, 0))
    cuts = np.flatnonzero(diff > np.maximum(mean + SPREAD * spread, FLOOR)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


# --- Spark ---------------------------------------------------------------------------------------------------------


def _batches(rows: Iterator[tuple[tuple, int]], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) with one AVI file a row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(len(batch)):
                    raw = batch.column(1)[i].as_buffer()
                    raw = raw.to_pybytes() if raw is not None else b""
                    media = write_avi(padded(raw))
                    yield (batch.column(0)[i].as_py(), len(raw), media), len(media)

        yield from _batches(rows(), ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return slim.mapInArrow(build, "doc_id long, n_bytes long, media binary")


CLIPS = "array<struct<clip:int,first_frame:int,end_frame:int,start_s:double,end_s:double>>"


def decode(media: DataFrame, tables: bytes = b"") -> DataFrame:
    """What is read back from (doc_id, n_bytes, media): digests of payload and file, clips, the feature string.

    ``tables`` is for DCT frames that leave theirs out, as for ``dct_frame``.
    """
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, n_bytes, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    buffer = item.as_buffer()
                    data = buffer.to_pybytes() if buffer is not None else b""
                    whole = (len(data), hashlib.sha256(data).hexdigest()) if buffer is not None else (None, None)
                    try:
                        jpegs, fps, length = read_avi(data)
                        if not jpegs:
                            raise ValueError("no frames")
                        frames = decode_frames(jpegs, tables)
                    except (ValueError, KeyError, IndexError, TypeError, struct.error) as error:
                        status = str(error) if isinstance(error, ValueError) and buffer is not None else "no file" if buffer is None else "damaged file"
                        yield (doc_id, n_bytes, None, None, None, *whole, None, None, status), 200
                        continue
                    payload = frames.tobytes()[:length]
                    cuts = shots(frames)
                    clips = [{"clip": k, "first_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps} for k, (a, b) in enumerate(cuts)]
                    level = int(frames.sum(dtype=np.int64)) // frames.size
                    feature = f"frames={len(frames)};shots={len(cuts)};mean={level};longest={max(b - a for a, b in cuts)}"
                    yield (
                        doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *whole, feature, clips, "decoded",
                    ), 400 + 40 * len(cuts)

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "status"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip, pa.string()]
        yield from _batches(rows(), names, kinds)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        parse,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        f"media_sha256 string, feature string, clips {CLIPS}, status string",
    )


def clip_rows(decoded: DataFrame) -> DataFrame:
    """One timed row per clip."""
    one: Column = F.explode("clips")  # undecoded files have none
    return decoded.select("doc_id", one.alias("c")).select("doc_id", "c.*")
