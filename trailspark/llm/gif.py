"""Media columns: animated GIF written and read without an imaging library.

``to_media`` stores bytes as 8-bit palette samples of 24 x 24 frames, coded by LZW
strings. A pixel that equals the frame before it is written as transparent where
the frame leaves a palette index free, so it is disposal (keep) and transparency
that give it back. ``features`` reads GIF in general: LZW code streams of any
growth, global and local palettes, interlacing, transparency, offsets, disposal
(keep, restore to background, restore to previous) and frame delays. It renders
timed frames; what it reports (payload, histogram) is taken from what is shown.

``parse`` reads one file, each stream by the general decoder. ``parse_all`` reads
many at once: streams of one clear code, as most small frames are, are decoded
together. A string code repeats what was put out where its string was first met,
and one letter more, so places are resolved by following such references from all
places at a time. All other streams go to the general decoder.

Defined results: a null or empty text is one frame of padding; each row is
encoded alone, so ties, repeated rows and null ids need nothing; other columns
are ignored; an empty table gives no rows. A file that is null, cut short or no GIF
has null in all columns but doc_id, n_bytes and feature, which is ``damaged``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column_bytes, slices

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
DELAY = 10
_CLEAR, _END = 256, 257
#: Frames that are coded, and files that are read, together.
_TOGETHER = 2048
_FILES = 256
_SINGLE = [bytes([i]) for i in range(256)]
#: Grey levels: sample n is the colour (n, n, n).
_PALETTE = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _strings(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of 8-bit LZW for rows of samples, all rows a step at a time; a row has fewer codes than fill the dictionary."""
    rows, size = frames.shape
    slots = 1 << (2 * size - 1).bit_length()
    keys, values = np.zeros((rows, slots), np.int32), np.zeros((rows, slots), np.int16)
    codes, at = np.zeros((rows, size + 2), np.int64), np.ones(rows, np.int64)
    codes[:, 0] = _CLEAR
    every, held = np.arange(rows), frames[:, 0].astype(np.int64)
    for j in range(1, size):
        s = frames[:, j].astype(np.int64)
        key = held << 8 | s
        slot = (key * 0x9E3779B1 >> 7) & (slots - 1)
        todo = every
        while todo.size:  # to the key's slot or a free one
            there = keys[todo, slot[todo]]
            todo = todo[(there != 0) & (there != key[todo] + 1)]
            slot[todo] = (slot[todo] + 1) & (slots - 1)
        known = keys[every, slot] != 0
        new = np.flatnonzero(~known)
        codes[new, at[new]] = held[new]
        keys[new, slot[new]] = key[new] + 1
        # the first code after the clear code adds no entry, each later one adds the next
        values[new, slot[new]] = _END + at[new]
        at[new] += 1
        held = np.where(known, values[every, slot], s)
    codes[every, at] = held
    codes[every, at + 1] = _END
    return codes, at + 2


def _compress(frames: np.ndarray) -> list[bytes]:
    """Code streams of rows of samples."""
    out: list[bytes] = []
    for lo in range(0, len(frames), _TOGETHER):
        codes, n = _strings(frames[lo : lo + _TOGETHER])
        # the width grows when the reader's dictionary holds 512 entries, after the clear code and 255 others
        bits = [(codes[:, a:b, None] >> np.arange(w) & 1).astype(np.uint8).reshape(len(codes), -1) for a, b, w in ((0, 256, 9), (256, codes.shape[1], 10))]
        data = np.packbits(np.concatenate(bits, axis=1), axis=1, bitorder="little")
        size = (np.minimum(n, 256) * 9 + np.maximum(n - 256, 0) * 10 + 7) // 8
        out += [row[:k].tobytes() for row, k in zip(data, size.tolist(), strict=True)]
    return out


def encode_all(payloads: list[np.ndarray], delay: int = DELAY, keep: bool = True) -> list[bytes]:
    """Bytes (multiples of FRAME) as animated GIFs; keep: pixels that do not change are transparent."""
    frames = np.concatenate(payloads).reshape(-1, FRAME) if payloads else np.zeros((0, FRAME), np.uint8)
    counts = [len(p) // FRAME for p in payloads]
    clear = np.full(len(frames), -1)
    if keep:
        used = np.zeros((len(frames), 256), bool)
        used[np.arange(len(frames))[:, None], frames] = True
        first = np.zeros(len(frames), bool)
        first[np.cumsum([0, *counts[:-1]])[: len(counts)]] = True
        some = np.flatnonzero(~first & ~used.all(axis=1))
        clear[some] = used[some].argmin(axis=1)
        same = frames[some] == frames[some - 1]
        frames = frames.copy()
        frames[some] = np.where(same, clear[some, None].astype(np.uint8), frames[some])
    streams = _compress(frames)
    descriptor = b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _PALETTE + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    out, at = [], 0
    for n in counts:
        parts = [head]
        for data, c in zip(streams[at : at + n], clear[at : at + n].tolist(), strict=True):
            # disposal 1: what is shown stays
            parts += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4 | (c >= 0), delay, max(c, 0), 0), descriptor]
            for k in range(0, len(data), 255):
                parts += [bytes([len(data[k : k + 255])]), data[k : k + 255]]
            parts.append(b"\0")
        out.append(b"".join([*parts, b"\x3b"]))
        at += n
    return out


def encode(payload: np.ndarray, delay: int = DELAY) -> bytes:
    """One payload with every pixel of every frame."""
    return encode_all([payload], delay, keep=False)[0]


def lzw(data: bytes, least: int, size: int) -> np.ndarray:
    """General decoder: samples of one code stream, at most ``size``."""
    clear, end = 1 << least, (1 << least) + 1
    out = bytearray()
    table: list[bytes] = []
    width, held, bits, last = least + 1, 0, 0, None
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == clear:
                table = _SINGLE[:clear] + [b"", b""]
                width, last = least + 1, None
                continue
            if code == end or len(out) >= size:
                return np.frombuffer(bytes(out[:size]).ljust(size, b"\x00"), np.uint8)
            if not table:
                table = _SINGLE[:clear] + [b"", b""]
            if last is None:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code beyond the table")
                entry = table[code] if code < len(table) else last + last[:1]
                if len(table) < 4096:
                    table.append(last + entry[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
            out += entry
            last = entry
    return np.frombuffer(bytes(out[:size]).ljust(size, b"\x00"), np.uint8)


def _together(streams: list[bytes], size: int) -> list[np.ndarray | None]:
    """Samples of 8-bit streams that hold one clear code, at their start, and at most 767 others; None for all others."""
    most = size + 3
    width = (256 * 9 + max(0, most - 256) * 10 + 7) // 8
    data = np.zeros((len(streams), width), np.uint8)
    for i, x in enumerate(streams):
        data[i, : min(width, len(x))] = np.frombuffer(x[:width], np.uint8)
    bits = np.unpackbits(data, axis=1, bitorder="little")
    nine = bits[:, : 256 * 9].reshape(len(data), 256, 9) @ (1 << np.arange(9))
    ten = bits[:, 256 * 9 :][:, : (bits.shape[1] - 256 * 9) // 10 * 10].reshape(len(data), -1, 10) @ (1 << np.arange(10))
    codes = np.concatenate([nine, ten], axis=1)[:, :most]
    ended = codes == _END
    stop = np.where(ended.any(axis=1), ended.argmax(axis=1), 0)
    index = np.arange(codes.shape[1])
    live = (index >= 1) & (index < stop[:, None])
    # a code may name the letters, the strings met before it, or the one that it completes
    ok = (stop > 1) & (codes[:, 0] == _CLEAR) & ((codes < _CLEAR) | (codes > _END) & (codes <= _END + index - 1) | ~live).all(axis=1)
    length = np.zeros(codes.shape, np.int64)
    of = np.maximum(codes - _END, 0)
    for i in range(1, codes.shape[1]):
        # string _END + n begins where the n-th code's does and is one letter longer
        length[:, i] = np.where(live[:, i], np.where(codes[:, i] < _CLEAR, 1, length[np.arange(len(codes)), np.minimum(of[:, i], i - 1)] + 1), 0)
    ok &= length.sum(axis=1) == size
    good = np.flatnonzero(ok)
    codes, length, of = codes[good], length[good], of[good]
    begin = np.cumsum(length, axis=1) - length + (np.arange(len(good)) * size)[:, None]
    flat = length.ravel()
    letter = np.repeat((codes < _CLEAR).ravel(), flat)
    source = np.repeat((np.take_along_axis(begin, np.where(codes > _END, of, 0), axis=1) - begin).ravel(), flat) + np.arange(len(good) * size)
    value = np.repeat(codes.ravel(), flat).astype(np.uint8)
    place = np.where(letter, np.arange(len(letter)), source)
    while not letter[place].all():
        place = place[place]
    out: list[np.ndarray | None] = [None] * len(streams)
    for i, row in zip(good.tolist(), value[place].reshape(-1, size), strict=True):
        out[i] = row
    return out


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    palette: bytes
    delay: int
    disposal: int
    clear: int | None
    interlaced: bool
    least: int
    data: bytes
    samples: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int
    frames: list[Frame]


def _blocks(raw: bytes) -> Gif:
    """Blocks of a GIF; code streams are not read yet."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", raw, 6)
    at = 13
    shared = b""
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        shared = raw[at : at + n]
        at += n
    frames: list[Frame] = []
    delay, disposal, clear = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while (n := raw[at]) != 0:
            parts.append(raw[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            label = raw[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                packed, delay = body[0], body[1] | body[2] << 8
                disposal, clear = packed >> 2 & 7, body[3] if packed & 1 else None
        elif raw[at] == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", raw, at + 1)
            at += 10
            palette = shared
            if packed & 0x80:
                n = 3 * (2 << (packed & 7))
                palette = raw[at : at + n]
                at += n
            least = raw[at]
            body, at = blocks(at + 1)
            frames.append(Frame(left, top, w, h, palette, delay, disposal, clear, bool(packed & 0x40), least, body))
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("unknown GIF block")
    return Gif(width, height, background, frames)


def _read(frame: Frame, samples_: np.ndarray | None) -> None:
    """A frame's samples in order of rows; read by the general decoder if they are not at hand."""
    frame.samples = lzw(frame.data, frame.least, frame.width * frame.height) if samples_ is None else samples_
    if frame.interlaced:
        order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, frame.height, step)]
        straight = np.empty((frame.height, frame.width), np.uint8)
        straight[order] = frame.samples.reshape(frame.height, frame.width)
        frame.samples = straight.ravel()


def parse(raw: bytes) -> Gif:
    """A GIF; samples are decoded, colours are not applied. What is no whole GIF raises ValueError."""
    try:
        gif = _blocks(raw)
        for f in gif.frames:
            _read(f, None)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF is cut short") from e
    return gif


def parse_all(raws: list[bytes | None]) -> list[Gif | None]:
    """Many GIFs, None for those that are none."""
    out: list[Gif | None] = []
    for raw in raws:
        try:
            out.append(_blocks(raw) if raw is not None else None)
        except (ValueError, IndexError, struct.error):
            out.append(None)
    alike: dict[int, list[Frame]] = {}
    for gif in out:
        for f in gif.frames if gif else ():
            if f.least == 8 and 0 < f.width * f.height <= 760:
                alike.setdefault(f.width * f.height, []).append(f)
    known: dict[int, np.ndarray | None] = {}
    for size, frames in alike.items():
        for lo in range(0, len(frames), _TOGETHER):
            part = frames[lo : lo + _TOGETHER]
            known |= zip(map(id, part), _together([f.data for f in part], size), strict=True)
    for i, gif in enumerate(out):
        try:
            for f in gif.frames if gif else ():
                _read(f, known.get(id(f)))
        except (ValueError, IndexError):
            out[i] = None
    return out


def render(gif: Gif):
    """(RGBA canvas, delay) of each frame with palettes, transparency and disposal applied."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    tables: dict[bytes, np.ndarray] = {}
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        if f.palette not in tables:
            tables[f.palette] = np.full((256, 4), 255, np.uint8)
            tables[f.palette][: len(f.palette) // 3, :3] = np.frombuffer(f.palette, np.uint8).reshape(-1, 3)
        colours = tables[f.palette]
        area = (slice(f.top, min(gif.height, f.top + f.height)), slice(f.left, min(gif.width, f.left + f.width)))
        samples = f.samples.reshape(f.height, f.width)[: area[0].stop - area[0].start, : area[1].stop - area[1].start]
        shown = colours[samples]
        if f.clear is not None:
            shown = np.where((samples == f.clear)[..., None], canvas[area], shown)
        canvas[area] = shown
        yield canvas.copy(), f.delay
        if f.disposal == 2:
            canvas[area] = 0
        elif f.disposal == 3:
            canvas = before


def payload_of(text: bytes | np.ndarray) -> np.ndarray:
    size = max(1, -(-len(text) // FRAME)) * FRAME
    out = np.full(size, PAD, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    return out


def samples(gif: Gif) -> np.ndarray:
    return np.concatenate([f.samples for f in gif.frames]) if gif.frames else np.zeros(0, np.uint8)


def luminance(shown: np.ndarray) -> np.ndarray:
    """0 to 255 of each pixel."""
    return shown[..., :3].astype(np.int64) @ np.array([299, 587, 114]) // 1000


def histogram(gif: Gif, bins: int = 16) -> list[int]:
    """Colour histogram: rendered luminance of all frames in equal bins."""
    total = np.zeros(bins, np.int64)
    for shown, _ in render(gif):
        total += np.bincount(luminance(shown).ravel() * bins // 256, minlength=bins)
    return total.tolist()


SCHEMA = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_cs long, histogram array<long>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes and the GIF that stores its bytes."""

    def run(batches):
        for b in slices(batches, "text", _TOGETHER * FRAME):
            raw, off = column_bytes(b.column("text"))
            made = encode_all([payload_of(raw[off[i] : off[i + 1]]) for i in range(b.num_rows)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _described(gif: Gif, stored: bytes) -> tuple:
    """What a GIF shows: the payload is the luminance of its frames, one after the other."""
    digest, tail, n, time, bins = hashlib.sha256(), b"", 0, 0, np.zeros(256, np.int64)
    for shown, delay in render(gif):
        lum = luminance(shown).astype(np.uint8).ravel()
        digest.update(lum)
        tail = (tail + lum[-32:].tobytes())[-32:]
        n, time = n + len(lum), time + delay
        bins += np.bincount(lum, minlength=256)
    mean = float(bins @ np.arange(256)) / n if n else 0.0
    h = bins.reshape(16, 16).sum(axis=1).tolist()
    return n, digest.hexdigest(), zlib.crc32(tail), len(stored), hashlib.sha256(stored).hexdigest(), f"frames={len(gif.frames)};cs={time};mean={mean:.4f};hist={'-'.join(map(str, h))}", len(gif.frames), time, h


def features(media: DataFrame) -> DataFrame:
    """Read stored GIFs back: digests of what they show, frames, time and colour histogram."""

    def run(batches):
        names = [x.strip().split()[0] for x in READ.split(", ")]
        for whole in batches:
            for lo in range(0, whole.num_rows, _FILES):
                b = whole.slice(lo, _FILES)
                stored = b.column("media").to_pylist()
                rows = [_described(g, raw) if g is not None else (None, None, None, None, None, "damaged", None, None, None) for g, raw in zip(parse_all(stored), stored, strict=True)]
                cols = [b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), _TYPES[2:], strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return media.mapInArrow(run, READ)
