"""Media columns: AVI files of motion-JPEG frames, their indexes, pictures and shots.

``encode`` stores bytes losslessly as the samples of baseline JPEG pictures: every byte is one flat
block of 8 x 8 grey pixels, whose quantised DC coefficient is the byte itself (quantiser 8), so that
any motion-JPEG reader sees exactly these greys.  A line of blocks is a restart interval.  The code
lengths make a difference of neighbours and its block end two whole bytes, which pack well.

``decode`` walks the RIFF chunks, finds frames through ``idx1``, decodes them and cuts the film into
shots where the change of histogram between frames stands out against the changes just before it.
The reader knows baseline frames in general (AC coefficients, several components, any sampling,
with or without restart intervals); the intervals of all frames in hand are decoded in step.

Defined results: a null text is empty and is stored as 64 zero bytes; equal texts give equal
bytes and values; repeated rows and further columns don't matter; a media value that is null or
no readable film gives null fields and no clips; a film that stores no payload of ours has clips but
null payload fields.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import chunks

#: Samples (blocks) of a line, and lines of a frame at most.
WIDTH, LINES = 64, 8
#: Lines coded in step.
BLOCK_LINES = 1 << 16
FPS = 25
#: Bins of a histogram; a cut needs this much change, and this many spreads above the mean of as
#: many changes before it.
BINS, LEAST_CHANGE, SPREADS, BEFORE = 16, 0.25, 3.0, 8

#: Fixed values of the format: the order in which a block's coefficients are stored.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


# Quantiser 8 for DC.  Size k of a difference has a code of 8 - k bits, so code and difference fill a
# byte; size 8 has one of 16 bits.  The only AC symbol, the end of a block, is a zero byte.
DC_SIZES = bytes([7, 6, 5, 4, 3, 2, 1, 0, 8])
TABLES = (
    _segment(0xDB, bytes([0, 8]) + bytes([1] * 63))
    + _segment(0xC4, bytes([0x00, *[1] * 8, *[0] * 7, 1]) + DC_SIZES)
    + _segment(0xC4, bytes([0x10, *[0] * 7, 1, *[0] * 8, 0]))
    + _segment(0xDD, struct.pack(">H", WIDTH))
)
SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def code_lines(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_code`` over any number of lines, a block at a time."""
    done = [_code(x[i : i + BLOCK_LINES]) for i in range(0, len(x), BLOCK_LINES)]
    before = np.cumsum([0, *(len(data) for data, _ in done)])
    return np.concatenate([data for data, _ in done]), np.concatenate([ends + at for (_, ends), at in zip(done, before, strict=False)])


def _code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of every line of samples, each followed by room for its restart marker;
    and where each line ends."""
    n = len(x)
    d = np.diff(x.astype(np.int16), axis=1, prepend=np.int16(128))
    size = np.array([int(v).bit_length() for v in range(256)], np.int16)[np.abs(d)]
    value = np.where(d < 0, d + (1 << size) - 1, d)
    code = (255 << (8 - (7 - size) - 1)) & 255  # 7 - size ones, then a zero
    wide = size == 8
    byte = np.where(wide, 255, (code & ~(1 << size) | value) & 255).astype(np.uint8)
    if not wide.any():
        out = np.zeros((n, 2 * WIDTH + 2), np.uint8)
        out[:, : 2 * WIDTH : 2] = byte
        return out.ravel(), np.arange(1, n + 1) * (2 * WIDTH + 2)
    # Wide ones: FF (stuffed with 00), 00, the value (stuffed where it is FF), and the block's end.
    full = wide & (value == 255)
    lengths = np.where(wide, np.where(full, 6, 5), 2)
    ends = np.cumsum(lengths.sum(axis=1) + 2)
    at = (np.cumsum(lengths, axis=1) - lengths) + (ends - lengths.sum(axis=1) - 2)[:, None]
    out = np.zeros(int(ends[-1]), np.uint8)
    out[at] = byte
    out[at[wide] + 3] = value[wide]
    return out, ends


def film(payload_size: int, frames: list[bytes], height: int) -> bytes:
    """An AVI file of JPEG frames; its comment holds the size of what they store."""
    largest = max(map(len, frames))
    w, h = 8 * WIDTH, 8 * height
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload %d\0" % payload_size))
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def films(payloads: list[bytes]) -> list[bytes]:
    """Files of payloads, each a positive multiple of ``WIDTH`` bytes."""
    lines = [len(p) // WIDTH for p in payloads]
    heights = [min(n, LINES) for n in lines]
    counts = [-(-n // h) * h for n, h in zip(lines, heights, strict=True)]
    padded = b"".join(p + b"\0" * (c * WIDTH - len(p)) for p, c in zip(payloads, counts, strict=True))
    data, ends = code_lines(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))
    # Restart markers 0 to 7 in turn; the last line of a frame gives its place to the end marker.
    within = np.concatenate([np.arange(c) % h for c, h in zip(counts, heights, strict=True)])
    last = within == np.repeat(heights, counts) - 1
    data[ends - 2], data[ends - 1] = 255, np.where(last, 0xD9, 0xD0 + within % 8)
    raw, cuts = data.tobytes(), np.concatenate([[0], ends[last]]).tolist()
    heads = {h: b"\xff\xd8" + TABLES + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * h, 8 * WIDTH, 1, 1, 0x11, 0)) + SCAN for h in set(heights)}
    out, k = [], 0
    for p, c, h in zip(payloads, counts, heights, strict=True):
        frames = [heads[h] + raw[cuts[i] : cuts[i + 1]] for i in range(k, k + c // h)]
        k += c // h
        out.append(film(len(p), frames, h))
    return out


def parse_film(data: bytes) -> tuple[int, float, list[tuple[int, int]]]:
    """Stored size (-1: none), frames a second, and ``(start, size)`` of each video frame, through the
    index, whose offsets count from the ``movi`` list or from the file's start."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    stored, rate, movi, index = -1, 0.0, -1, b""
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + size]
            elif name == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack_from("<II", data, at + 28)
                rate = per / scale if scale else 0.0
            elif name == b"ICMT" and data[at + 8 : at + 16] == b"payload ":
                stored = int(data[at + 16 : at + 8 + size].split(b"\0")[0])
            at += 8 + size + (size & 1)
    own = [(off, size) for name, _, off, size in struct.iter_unpack("<4sIII", index) if name[2:] in (b"dc", b"db") and size]
    if movi < 0 or not own or not rate:
        raise ValueError("a film without frames or index")
    base = movi if data[movi + own[0][0] + 2 : movi + own[0][0] + 4] in (b"dc", b"db") else 0
    return stored, rate, [(base + off + 8, size) for off, size in own]


class Frame:
    """What the header of a baseline picture says."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG picture")
        self.quant, self.codes, self.interval, self.parts = {}, {}, 0, []
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    self.quant[body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    self.codes[body[0]] = body[1:n]
                    body = body[n:]
            elif marker in (0xC0, 0xC1):
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if body[0] != 8 or not self.height or not self.width:
                    raise ValueError("not a picture this reader knows")
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not a baseline picture")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                if len(tables) != len(self.parts):
                    raise ValueError("components in several scans")
                self.head = data[: at + 2 + size]
                break
            at += 2 + size
        if len(self.parts) == 1:  # a single component is stored block by block
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.across, self.down = max(h for _, h, _, _ in self.parts), max(v for _, _, v, _ in self.parts)
        self.columns, self.rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        #: The component of each block of a unit, and what decoding needs besides the coded part.
        self.pattern = tuple(i for i, (_, h, v, _) in enumerate(self.parts) for _ in range(h * v))
        own = [(self.codes[tables[c] >> 4], self.codes[0x10 | tables[c] & 15]) for c, *_ in self.parts]
        self.kind = (self.pattern, tuple(own))

        units = self.columns * self.rows
        step = self.interval or units
        #: Blocks of each restart interval.
        self.blocks = [min(step, units - i) * len(self.pattern) for i in range(0, units, step)]


_HEADS: dict[bytes, Frame] = {}


def frame(data: bytes) -> tuple[Frame, bytes]:
    """The header of a picture, parsed once for pictures that share it, and the coded part."""
    for head, known in _HEADS.items():
        if data.startswith(head):
            return known, data[len(head) :]
    if len(_HEADS) >= 2 * LINES:
        _HEADS.clear()
    found = Frame(data)
    _HEADS[found.head] = found
    return found, data[len(found.head) :]


#: What a code table gives where 16 bits don't settle it, and for the end of a block.
LONG, END = 254, 255

_CODES: dict[tuple[bytes, bool], tuple[np.ndarray, ...]] = {}


def code_table(table: bytes, dc: bool) -> tuple[np.ndarray, ...]:
    """For every 16 bits: the value and number of zeros before it that they begin with, the bits both
    take (0: no code), and the value's size (for ``LONG`` ones, whose value lies behind)."""
    if (table, dc) not in _CODES:
        value, run, bits, sizes = (np.zeros(1 << 16, t) for t in (np.int16, np.uint8, np.uint8, np.uint8))
        code, k, window = 0, 16, np.arange(1 << 16)
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                if code >> n:
                    raise ValueError("more codes than there is room for")
                own = slice(code << (16 - n), (code + 1) << (16 - n))
                size, zeros = (table[k], 0) if dc else (table[k] & 15, table[k] >> 4)
                bits[own], run[own], sizes[own] = n + size, zeros, size
                if n + size > 16:
                    run[own] = LONG
                    value[own] = n | zeros << 8
                elif size:
                    v = window[own] >> (16 - n - size) & ((1 << size) - 1)
                    value[own] = np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)
                elif not dc and zeros < 15:
                    run[own] = END
                code, k = code + 1, k + 1
            code <<= 1
        _CODES[table, dc] = value, run, bits, sizes
    return _CODES[table, dc]


def decode_frames(frames: list[Frame], scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """DC coefficients (still quantised) of all blocks of frames of one kind, one after the other, and
    the other coefficients that are not zero: block, place in zigzag order, value.

    Each restart interval is a lane; a step decodes one symbol of every lane that is not done.
    """
    pattern, tables = np.array(frames[0].pattern), frames[0].kind[1]
    values, runs, widths, sizes = (np.concatenate(x) for x in zip(*(code_table(t, i == 0) for pair in tables for i, t in enumerate(pair)), strict=True))
    raw = np.frombuffer(b"".join(scans) + b"\0" * 8, np.uint8)
    after = np.concatenate([[0], raw[:-1]]) == 255
    marker = after & (raw >= 0xD0) & (raw <= 0xD9)
    keep = ~(after & (raw == 0) | marker)
    keep[np.flatnonzero(marker) - 1] = False
    # An interval starts where its bytes do: after as many kept bytes as lie before its marker.
    ends = np.cumsum(keep)[np.flatnonzero(marker)]
    todo = np.array([n for f in frames for n in f.blocks])
    if len(ends) != len(todo):
        raise ValueError("intervals are missing")
    clean = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]

    def ahead(at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return (window[at >> 3] << (at & 7).astype(np.uint32) >> np.uint32(16)).astype(np.int64)

    at, limit = np.concatenate([[0], ends[:-1]]) * 8, ends * 8
    start = np.cumsum(todo) - todo
    block, stop, row = start.copy(), start + todo, np.arange(len(todo))
    level = np.zeros((len(todo), len(tables)), np.int64)
    dc, ac = np.zeros(int(todo.sum()), np.int16), []
    k: int | np.ndarray = 0  # the next place in the block, one number where it is the same in all lanes
    while len(row):
        part = pattern[(block - start) % len(pattern)] if len(pattern) > 1 else 0
        which = ahead(at) + ((2 * part + (k > 0)) << 16)
        value, run, width = values[which].astype(np.int64), runs[which], widths[which]
        if not width.all():
            raise ValueError("a code that the table lacks")
        long = np.flatnonzero(run == LONG)
        at = at + width
        if len(long):
            size, about = sizes[which[long]].astype(np.int64), value[long]
            v = ahead(at[long] - size) >> (16 - size)
            value[long], run[long] = np.where(v < (1 << size >> 1), v - (1 << size) + 1, v), about >> 8
        if isinstance(k, int) and k == 0:
            if len(tables) == 1:
                level[:, 0] += value
                dc[block] = level[:, 0]
            else:
                level[np.arange(len(row)), part] += value
                dc[block] = level[np.arange(len(row)), part]
            k = 1
            continue
        end = run == END
        if isinstance(k, int) and end.all():
            block, k = block + 1, 0
        else:
            k = np.full(len(row), k) if isinstance(k, int) else k
            is_dc = k == 0
            own = part if len(pattern) > 1 else np.zeros(len(row), np.int64)
            d = np.flatnonzero(is_dc)
            level[d, own[d]] += value[d]
            dc[block[d]] = level[d, own[d]]
            place = np.where(is_dc, 0, k + run)
            a = np.flatnonzero(~is_dc & (value != 0) & ~end)
            if (place[a] > 63).any():
                raise ValueError("more coefficients than a block has")
            ac.append(np.stack([block[a], place[a], value[a]]))
            done = ~is_dc & (end | (place >= 63))
            k, block = np.where(done, 0, place + 1), block + done
            if not k.any():
                k = 0
        left = block < stop
        if not left.all():
            if (at[~left] > limit[~left]).any():
                raise ValueError("an interval that ends early")
            row, block, stop, at, limit, start, level = (x[left] for x in (row, block, stop, at, limit, start, level))
            k = k if isinstance(k, int) else k[left]
    found = np.concatenate(ac, axis=1) if ac else np.zeros((3, 0), np.int64)
    order = np.argsort(found[0], kind="stable")
    return dc, *found[:, order]


COSINES = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def pictures(frames: list[Frame], scans: list[bytes]) -> list[tuple[np.ndarray, bool]]:
    """The samples of each frame's first component, and whether these are blocks (a flat one is one
    sample) or pixels; frames of one kind."""
    dc, where, place, value = decode_frames(frames, scans)
    levels = {f.quant[f.parts[0][3]][0] for f in frames}
    scale = levels.pop() if len(levels) == 1 and not len(where) and len(frames[0].pattern) == 1 else 1
    flat = np.clip(dc.astype(np.int64) * (scale // 8) + 128, 0, 255).astype(np.uint8) if scale % 8 == 0 else None
    out, at = [], 0
    for f in frames:
        n = sum(f.blocks)
        own = slice(*np.searchsorted(where, [at, at + n])) if flat is None else None
        out.append((flat[at : at + n], True) if flat is not None else (_pixels(f, dc[at : at + n], where[own] - at, place[own], value[own]), False))
        at += n
    return out


def _pixels(f: Frame, dc: np.ndarray, where: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The first component of one frame from its coefficients."""
    _, across, down, q = f.parts[0]
    coef = np.zeros((len(dc), 64))
    coef[:, 0], coef[where, place] = dc, value
    luma = np.flatnonzero(np.array(f.pattern) == 0)
    blocks = (np.arange(f.columns * f.rows)[:, None] * len(f.pattern) + luma).ravel()
    square = np.zeros((len(blocks), 64))
    square[:, ZIGZAG] = coef[blocks] * np.array(f.quant[q])
    pixels = np.einsum("ux,nuv,vy->nxy", COSINES, square.reshape(-1, 8, 8), COSINES, optimize=True)
    whole = pixels.reshape(f.rows, f.columns, down, across, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(f.rows * down * 8, -1)
    h, w = -(-f.height * down // f.down), -(-f.width * across // f.across)
    return np.clip(np.rint(whole[:h, :w] + 128), 0, 255).astype(np.uint8)


def shots(frames: np.ndarray) -> list[int]:
    """First frames of shots: the first of all, and each whose change of histogram is large in
    itself and against the changes before it."""
    n = len(frames)
    bins = (frames.reshape(n, -1) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    hist = np.bincount(bins.ravel(), minlength=BINS * n).reshape(n, BINS) / bins.shape[1]
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i in (np.flatnonzero(change > LEAST_CHANGE) + 1).tolist():
        past = change[max(cuts[-1], i - 1 - BEFORE) : i - 1]
        if not len(past) or change[i - 1] > past.mean() + SPREADS * past.std():
            cuts.append(i)
    return cuts


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as a film."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            sizes, payloads = zip(*map(padded, texts), strict=True)
            cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(films(list(payloads)), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIPS = "array<struct<clip:int,start_s:double,end_s:double,frames:int,mean:double>>"
CLIP_TYPE = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("mean", pa.float64())]))
DECODED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips " + CLIPS
UNREAD = (ValueError, IndexError, KeyError, struct.error)


def _read(films_: list[bytes | None]) -> list[tuple]:
    """The decoded fields of each film; frames of one kind are decoded together, whoever's they are."""
    parsed, kinds = [], {}
    for i, data in enumerate(films_):
        try:
            stored, rate, places = parse_film(data or b"")
            frames = [frame(data[s : s + n]) for s, n in places]
        except UNREAD:
            parsed.append(None)
            continue
        parsed.append((stored, rate, len(frames)))
        for k, (f, scan) in enumerate(frames):
            kinds.setdefault(f.kind, []).append((i, k, f, scan))
    shown: list[dict] = [{} for _ in films_]
    for own in kinds.values():
        try:
            for (i, k, *_), picture in zip(own, pictures([x[2] for x in own], [x[3] for x in own]), strict=True):
                shown[i][k] = picture
        except UNREAD:
            if len(films_) > 1:  # a damaged film among them: one by one
                return [x for f in films_ for x in _read([f])]
            parsed = [None]
    return [_fields(p, data, pics) for p, data, pics in zip(parsed, films_, shown, strict=True)]


def _fields(parsed: tuple | None, data: bytes | None, pics: dict) -> tuple:
    if parsed is None:
        return (None,) * 5 + ([],)
    stored, rate, n = parsed
    size = {x.shape for x, _ in pics.values()}
    frames = np.stack([pics[k][0].ravel() for k in range(n)]) if len(size) == 1 else np.zeros((0, 1), np.uint8)
    payload = frames.tobytes()[:stored] if stored >= 0 and all(flat for _, flat in pics.values()) else None
    cuts = [*shots(frames), n] if len(frames) else []
    clips = [{"clip": i, "start_s": a / rate, "end_s": b / rate, "frames": b - a, "mean": round(float(frames[a:b].mean()), 6)} for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    about = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    return (*about, len(data), hashlib.sha256(data).hexdigest(), clips)


def decode(media: DataFrame) -> DataFrame:
    """The columns of ``media`` with its ``media`` column replaced by what decoding it gives."""
    others = [f for f in media.schema.fields if f.name != "media"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [DECODED])
    names = [f.name for f in others] + ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), CLIP_TYPE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("media")
            at, size = 0, 0
            for i in range(len(data)):
                size += data[i].as_buffer().size if data[i].is_valid else 0
                if size < 2 << 20 and i < len(data) - 1:
                    continue
                rows = _read(data.slice(at, i + 1 - at).to_pylist())
                cols = [b.column(f.name).slice(at, i + 1 - at) for f in others]
                cols += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names)
                at, size = i + 1, 0

    return media.mapInArrow(run, schema)


def clips(decoded: DataFrame) -> DataFrame:
    """One timed row per clip."""
    return decoded.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def feature(clips: Column) -> Column:
    """The clips of a film as text: times and mean sample of each."""
    one = lambda c: F.format_string("%.2f-%.2f:%.3f", c["start_s"], c["end_s"], c["mean"])
    return F.concat(F.size(clips).cast("string"), F.lit(" "), F.array_join(F.transform(clips, one), " "))
