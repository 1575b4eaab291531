"""AVI motion-JPEG: RIFF index parsing, decoding of intra frames and shot detection by adaptive histogram differences.

Two halves. ``write_avi``/``read_avi`` keep bytes in the quantised coefficients of baseline grey JPEG frames, 64 bytes an 8x8
block, which no step of the format rounds: coefficient = 256 + byte, so each has the same Huffman category and all blocks the
same number of bits, and whole frames are packed and unpacked by array operations. ``decode_jpeg`` reads any baseline frame of
one or three components, by its own tables, those of its film or the usual ones of motion-JPEG; ``shots`` cuts a film where histograms
of neighbouring pictures differ by more than the film's own usual difference, and ``clips`` gives timed rows. The stored film of
a text is read back by that decoder: its payload from the coefficients, its shots from the pictures.

Defined results: a null or empty text is one block of zeros; equal texts give equal files; an empty table gives an empty result;
null and repeated doc_ids are kept; very long texts are films of many frames; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Order of coefficients in a JPEG block: fixed by the format (ITU T.81), made here from its rule, a zigzag over diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) if (k // 8 + k % 8) % 2 else (k % 8))))
FPS = 25
FRAME_BLOCKS = 256
BLOCK_BITS = 641  # 11 bits of the DC difference and 63 times 1 + 9


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Huffman codes of the frames written here. DC: category 10 is '0', category 9 is '10', 0 is '110'. AC: category 9 is '0', end of block '10'.
_DC = bytes([1, 1, 1] + [0] * 13) + bytes([10, 9, 0])
_AC = bytes([1, 1] + [0] * 14) + bytes([0x09, 0x00])


def _header(width: int, height: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
        + _segment(0xC4, b"\0" + _DC) + _segment(0xC4, b"\x10" + _AC) + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


_NINE = 1 << np.arange(8, -1, -1)
_TEN = 1 << np.arange(9, -1, -1)


def encode_frame(payload: bytes, width: int, height: int) -> bytes:
    """A grey JPEG whose blocks, in raster order and zigzag order in each, hold the payload; missing blocks are zero bytes."""
    blocks = (width // 8) * (height // 8)
    b = np.zeros(blocks * 64, np.uint8)
    b[: len(payload)] = np.frombuffer(payload, np.uint8)
    b = b.reshape(blocks, 64)
    bits = np.zeros((blocks, BLOCK_BITS), np.uint8)
    # The DC value is +(256 + byte) in even and -(256 + byte) in odd blocks: differences are of category 10 but for the first's 9.
    dc = (256 + b[:, 0].astype(np.int32)) * np.where(np.arange(blocks) % 2, -1, 1)
    diff = np.diff(dc, prepend=0)
    amp = np.where(diff < 0, diff + 1023, diff)
    bits[:, 1:11] = (amp[:, None] & _TEN) != 0
    bits[0, :11] = [1, 0, *((diff[0] & _NINE) != 0)]
    ac = bits[:, 11:].reshape(blocks, 63, 10)
    ac[:, :, 1] = 1
    ac[:, :, 2:] = np.unpackbits(b[:, 1:], axis=1).reshape(blocks, 63, 8)
    flat = bits.ravel()
    pad = -len(flat) % 8
    scan = np.packbits(np.concatenate([flat, np.ones(pad, np.uint8)])).tobytes().replace(b"\xff", b"\xff\0")
    return _header(width, height) + scan + b"\xff\xd9"


def stored_bytes(coefficients: np.ndarray) -> np.ndarray:
    """The bytes, 64 a block, in the coefficients of a frame written here."""
    return (np.abs(coefficients) - 256).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def shape(n_blocks: int) -> tuple[int, int, int]:
    """(frames, width, height): up to FRAME_BLOCKS blocks a frame, rows of up to 16 blocks."""
    frames = -(-n_blocks // FRAME_BLOCKS)
    per = -(-n_blocks // frames)
    wide = min(16, per)
    return frames, wide * 8, -(-per // wide) * 8


def write_avi(payload: bytes) -> bytes:
    """An AVI with one MJPG stream, an idx1 index and, in a JUNK-safe chunk of its own, the payload's length."""
    n = max(1, -(-len(payload) // 64))
    frames, width, height = shape(n)
    step = (width // 8) * (height // 8) * 64
    data = [_chunk(b"00dc", encode_frame(payload[k * step : (k + 1) * step], width, height)) for k in range(frames)]
    largest = max(map(len, data))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    at, index = 4, []
    for c in data:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, struct.unpack("<I", c[4:8])[0]))
        at += len(c)
    body = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf))) + _chunk(b"plen", struct.pack("<Q", len(payload)))
    return _chunk(b"RIFF", b"AVI " + body + _list(b"movi", *data) + _chunk(b"idx1", b"".join(index)))


def _walk(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, n = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + n, end)
        at += 8 + n + n % 2


def parse_avi(avi: bytes) -> dict:
    """Frame rate, size, payload length if given, and (offset, length) of each video chunk: by idx1 where it is, else by the movi list."""
    data = memoryview(avi)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"fps": float(FPS), "width": 0, "height": 0, "length": None, "frames": []}
    movi, index = None, None

    def into(at: int, end: int) -> None:
        nonlocal movi, index
        for name, a, b in _walk(data, at, end):
            if name == b"LIST":
                kind = bytes(data[a : a + 4])
                if kind == b"movi":
                    movi = (a, b)
                elif kind in (b"hdrl", b"strl", b"odml"):
                    into(a + 4, b)
            elif name == b"avih":
                micros = struct.unpack_from("<I", data, a)[0]
                out["fps"] = 1e6 / micros if micros else out["fps"]
                out["width"], out["height"] = struct.unpack_from("<II", data, a + 32)
            elif name == b"plen":
                out["length"] = struct.unpack_from("<Q", data, a)[0]
            elif name == b"idx1":
                index = (a, b)

    into(12, len(avi))
    if movi is None:
        return out
    if index:
        rows = [struct.unpack_from("<4sIII", data, k) for k in range(index[0], index[1] - 15, 16)]
        own = [r for r in rows if r[0][2:4] in (b"dc", b"db")]
        # Offsets count from the movi list or from the file's start; the first entry tells which.
        base = 0 if own and bytes(data[own[0][2] : own[0][2] + 4]) == own[0][0] else movi[0]
        out["frames"] = [(base + o + 8, n) for _, _, o, n in own]
    else:
        out["frames"] = [(a, b - a) for name, a, b in _walk(data, movi[0] + 4, movi[1]) if name[2:4] in (b"dc", b"db")]
    return out


def read_avi(avi: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload of a film written here, and its decoded pictures."""
    info = parse_avi(avi)
    decoded = [decode_coefficients(avi[a : a + n]) for a, n in info["frames"]]
    return b"".join(stored_bytes(c).tobytes() for _, c in decoded)[: info["length"]], [picture(f, c) for f, c in decoded]


# -- general baseline JPEG ---------------------------------------------------------------------------------------------

_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.left, self.held = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.left += 8
        self.left -= n
        v = self.held >> self.left
        self.held &= (1 << self.left) - 1
        return v

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def number(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Frame:
    """What the markers of a baseline JPEG say: size, components, tables, and the entropy-coded runs between restart markers.

    Tables that a frame leaves out are those of the film's first frame (``inherit``) or the usual ones of motion-JPEG."""

    def __init__(self, data: bytes, inherit: "Frame | None" = None) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        at, self.interval, size, scan = 2, 0, None, None
        self.quant = dict(inherit.quant) if inherit else {}
        self.tables: dict[int, tuple[bytes, bytes]] = dict(inherit.tables) if inherit else dict(_usual())
        while scan is None:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            k = 0
            if marker == 0xDB:
                while k < len(body):
                    wide = body[k] >> 4
                    own = 128 if wide else 64
                    self.quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + own], ">u2" if wide else "u1").astype(np.int32)
                    k += 1 + own
            elif marker in (0xC0, 0xC1):
                _, h, w, c = struct.unpack_from(">BHHB", body)
                size = (h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(c)])
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline frames are decoded")
            elif marker == 0xC4:
                while k < len(body):
                    total = sum(body[k + 1 : k + 17])
                    self.tables[body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + total])
                    k += 17 + total
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
        if size is None:
            raise ValueError("a scan without a frame header")
        self.scan = scan
        self.height, self.width, self.parts = size
        self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            self.parts, self.hmax, self.vmax = [(self.parts[0][0], 1, 1, self.parts[0][3])], 1, 1
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        end = data.rfind(b"\xff\xd9")
        if end < at:
            raise ValueError("a frame without an end")
        self.runs = [r.replace(b"\xff\0", b"\xff") for r in re.split(rb"\xff[\xd0-\xd7]", data[at:end])]


def _usual() -> dict[int, tuple[bytes, bytes]]:
    """The Huffman tables that motion-JPEG frames may leave out (ITU T.81, K.3 to K.6): counts by length, and symbols. Fixed values."""
    dc = bytes(range(12))
    light = bytes.fromhex(
        "0102030004110512213141061351610722711432819 1a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a"
        "636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6"
        "e7e8e9eaf1f2f3f4f5f6f7f8f9fa".replace(" ", "")
    )
    colour = bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a"
        "636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6"
        "e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")
    )
    return {
        0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), dc), 0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), dc),
        0x10: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]), light), 0x11: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 0x77]), colour),
    }


def _even_blocks(f: Frame) -> np.ndarray | None:
    """Coefficients of a frame all of whose blocks have the same number of bits, decoded for all blocks at once; None for any other frame.

    True of one component whose AC table gives '0' to a value of category c without zeros before it, and whose blocks hold 63 of them:
    the places of all codes but the DC's are then known, and are checked to be what the table says."""
    dc, ac = f.tables.get(f.scan[f.parts[0][0]][0]), f.tables.get(0x10 | f.scan[f.parts[0][0]][1])
    if len(f.parts) != 1 or len(f.runs) != 1 or not ac or not dc or not ac[0][0] or ac[1][0] >> 4 or not ac[1][0]:
        return None
    size, n = ac[1][0], f.across * f.down
    codes = {c: (length, code) for (length, code), c in _codes(*dc).items()}
    bits = np.unpackbits(np.frombuffer(f.runs[0], np.uint8))
    tail = 63 * (1 + size)
    # The first block's DC may be of another category than the rest, all of which are of one.
    for first_cat, cat in ((a, b) for a in codes for b in codes):
        (l0, c0), (l1, c1) = codes[first_cat], codes[cat]
        head, step = l0 + first_cat, l1 + cat + tail
        total = head + tail + (n - 1) * step
        if not total <= len(bits) < total + 8 or not bits[total:].all():
            continue
        if head == l1 + cat:
            blocks = bits[:total].reshape(n, step)
        else:
            blocks = np.zeros((n, max(step, head + tail)), np.uint8)
            width = blocks.shape[1]
            blocks[0, width - head - tail :] = bits[: head + tail]
            blocks[1:, width - step :] = bits[head + tail : total].reshape(n - 1, step)
        acs = blocks[:, blocks.shape[1] - tail :].reshape(n, 63, 1 + size)
        lead = blocks[:, : blocks.shape[1] - tail]
        word = lambda rows, k: rows @ (1 << np.arange(rows.shape[1] - 1, -1, -1)) if k else np.zeros(len(rows), np.int64)
        first_lead, rest = lead[:1, lead.shape[1] - head :], lead[1:, lead.shape[1] - (l1 + cat) :]
        if acs[:, :, 0].any() or word(first_lead[:, :l0].astype(np.int64), l0)[0] != c0 or (n > 1 and (word(rest[:, :l1].astype(np.int64), l1) != c1).any()):
            continue
        signed = lambda v, c: np.where(v >> (c - 1), v, v - (1 << c) + 1) if c else v
        diff = np.concatenate([signed(word(first_lead[:, l0:].astype(np.int64), first_cat), first_cat), signed(word(rest[:, l1:].astype(np.int64), cat), cat)])
        out = np.empty((n, 64), np.int32)
        out[:, 0] = np.cumsum(diff)
        out[:, 1:] = signed(acs[:, :, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32)), size)
        return out
    return None


def _all_blocks(f: Frame) -> np.ndarray:
    """Coefficients of the first component of any baseline frame, block after block of its own grid."""
    huff = {k: _codes(*t) for k, t in f.tables.items()}
    _, h0, v0, _ = f.parts[0]
    coef = np.zeros((f.down * v0, f.across * h0, 64), np.int32)
    mcu = 0
    for run in f.runs:
        bits, last = _Bits(run), dict.fromkeys((p[0] for p in f.parts), 0)
        for _ in range(min(f.interval or f.across * f.down, f.across * f.down - mcu)):
            for ci, (cid, hs, vs, _) in enumerate(f.parts):
                dct, act = f.scan[cid]
                for v in range(vs):
                    for x in range(hs):
                        row = np.zeros(64, np.int32)
                        last[cid] += bits.number(bits.symbol(huff[dct]))
                        row[0] = last[cid]
                        i = 1
                        while i < 64:
                            s = bits.symbol(huff[0x10 | act])
                            if not s & 15:
                                if s != 0xF0:
                                    break
                                i += 16
                                continue
                            i += s >> 4
                            row[i] = bits.number(s & 15)
                            i += 1
                        if ci == 0:
                            coef[(mcu // f.across) * v0 + v, (mcu % f.across) * h0 + x] = row
            mcu += 1
    return coef.reshape(-1, 64)


def decode_coefficients(data: bytes, inherit: Frame | None = None) -> tuple[Frame, np.ndarray]:
    """(frame, quantised coefficients of the first component, a row a block in raster order)."""
    f = Frame(data, inherit)
    even = _even_blocks(f)
    return f, _all_blocks(f) if even is None else even


def picture(f: Frame, coefficients: np.ndarray) -> np.ndarray:
    """Grey samples, height x width, uint8."""
    _, h0, v0, q0 = f.parts[0]
    return samples(coefficients * f.quant[q0], f.across * h0)[: -(-f.height * v0 // f.vmax), : -(-f.width * h0 // f.hmax)]


def decode_jpeg(data: bytes, inherit: Frame | None = None) -> np.ndarray:
    """Grey samples (the first component) of a baseline JPEG."""
    return picture(*decode_coefficients(data, inherit))


def samples(coefficients: np.ndarray, across: int) -> np.ndarray:
    """Dequantised zigzag coefficients, a row a block, to a picture of 8-bit samples."""
    grid = np.zeros((len(coefficients), 64))
    grid[:, ZIGZAG] = coefficients
    px = _COS @ grid.reshape(-1, 8, 8) @ _COS.T + 128
    down = len(coefficients) // across
    return np.clip(np.rint(px), 0, 255).astype(np.uint8).reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)


# -- shots -------------------------------------------------------------------------------------------------------------


def histogram(values: np.ndarray, bins: int = 32) -> np.ndarray:
    h = np.bincount(values.ravel() >> 3, minlength=bins).astype(np.float64)
    return h / max(h.sum(), 1)


def shots(hists: list[np.ndarray], window: int = 12, factor: float = 3.0, least: float = 0.15) -> list[int]:
    """Frames that start a shot: where the difference to the frame before exceeds the mean of the last differences in the shot
    by ``factor`` deviations and is at least ``least`` (half the sum of absolute differences, 0 to 1)."""
    starts, recent = [0], []
    for k in range(1, len(hists)):
        d = float(np.abs(hists[k] - hists[k - 1]).sum() / 2)
        usual = (np.mean(recent) + factor * np.std(recent)) if recent else 0.0
        if d >= max(least, usual):
            starts.append(k)
            recent = []
        else:
            recent = [*recent[-window + 1 :], d]
    return starts if hists else []


def pictures(avi: bytes, info: dict) -> Iterator[np.ndarray | None]:
    """Each frame's picture. An empty frame repeats the one before, as players show it; None is a frame that cannot be decoded."""
    first, last = None, None
    for a, n in info["frames"]:
        if n:
            try:
                f, c = decode_coefficients(avi[a : a + n], first)
                first, last = first or f, picture(f, c)
            except (ValueError, IndexError, KeyError, struct.error):
                yield None
                continue
        yield last


def clips(avi: bytes) -> list[dict]:
    """clip, first_frame, n_frames, start_s, end_s, bad_frames of each shot of an AVI of baseline JPEG frames. A frame that cannot be
    decoded is counted and stays in the shot around it; it does not take part in the differences."""
    info = parse_avi(avi)
    hists = [None if p is None else histogram(p) for p in pictures(avi, info)]
    good = [k for k, h in enumerate(hists) if h is not None]
    starts = [good[k] for k in shots([hists[k] for k in good])] or [0] * bool(hists)
    starts[:1] = [0] * bool(hists)
    ends = [*starts[1:], len(hists)]
    return [{"clip": i, "first_frame": a, "n_frames": b - a, "start_s": a / info["fps"], "end_s": b / info["fps"], "bad_frames": sum(h is None for h in hists[a:b])} for i, (a, b) in enumerate(zip(starts, ends))]


CLIPS = "clip int, first_frame int, n_frames int, start_s double, end_s double, bad_frames int"


def clip_rows(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """(key, clip, first_frame, n_frames, start_s, end_s, bad_frames) from a column of AVI bytes. Bytes that are no AVI, and nulls, give no
    rows; a broken frame costs itself, not its film."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, rows = [], []
            for i, b in enumerate(part.column(column).to_pylist()):
                try:
                    found = clips(b) if b else []
                except (ValueError, struct.error):  # of the container; frames are handled one by one
                    found = []
                keys += [i] * len(found)
                rows += found
            cols = [part.column(key).take(pa.array(keys, pa.int64()))]
            kinds = (("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("bad_frames", pa.int32()))
            yield pa.record_batch([*cols, *[pa.array([r[k] for r in rows], t) for k, t in kinds]], names=[key, *[k for k, _ in kinds]])

    return media.select(key, column).mapInArrow(run, f"{key} {media.schema[key].dataType.simpleString()}, {CLIPS}")


def text_films(docs: DataFrame) -> DataFrame:
    """(media_id, media): each text as a film, a media table for ``clip_rows``; a film is as long as its text in frames."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 16):
                p = part.slice(k, 16)
                films = [write_avi(_payload(t)[1]) for t in p.column("text").to_pylist()]
                yield pa.record_batch([p.column("doc_id"), pa.array(films, pa.binary())], names=["media_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "media_id long, media binary")


def _payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: str | None) -> tuple:
    """Of a text: its film is written, its frames are decoded to pictures, and shots are cut where these differ."""
    n, payload = _payload(text)
    avi = write_avi(payload)
    back, frames = read_avi(avi)
    starts = shots([histogram(p) for p in frames])
    feature = f"frames={len(frames)};shots={','.join(f'{s / FPS:.2f}' for s in starts)}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature


def text_media(docs: DataFrame) -> DataFrame:
    """Each text as an AVI, read back: digests, and shots as the feature. One pass; a film lives only while its row is made."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 1000):
                p = part.slice(k, 1000)
                cols = list(zip(*map(digest, p.column("text").to_pylist())))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([p.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def media_clips(spark, sf_dir: str) -> DataFrame:
    """Timed clips of the films of all texts."""
    return clip_rows(text_films(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("media_id", "doc_id")


def op7_media(spark, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
