import hashlib
import itertools
import statistics
import zlib
from collections import Counter

import numpy as np
import pytest

from lecturelake.llm import avi as a


def stored(text):
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


@pytest.mark.parametrize("size", [64, 128, 4096, 4160, 64 * 200])
def test_round_trip_of_all_bytes(size):
    data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    (film,) = a.films([data])
    row = a._read([film])[0]
    assert row[:3] == (size, hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    _, rate, places = a.parse_film(film)
    assert rate == a.FPS and all(film[s : s + 2] == b"\xff\xd8" and film[s + n - 2 : s + n] == b"\xff\xd9" for s, n in places)


def test_blocks_do_not_matter(monkeypatch):
    payloads = [np.random.default_rng(i).integers(0, 256, 64 * n).astype(np.uint8).tobytes() for i, n in enumerate((1, 64, 65, 300, 7))]
    whole = a.films(payloads)
    monkeypatch.setattr(a, "BLOCK_LINES", 50)
    assert a.films(payloads) == whole
    assert [r[1] for r in a._read(whole)] == [hashlib.sha256(p).hexdigest() for p in payloads]


def test_extreme_differences():
    data = bytes([0, 255] * 32) + bytes([255, 0] * 32) + bytes(64) + bytes([255] * 64)
    assert a._read(a.films([data]))[0][1] == hashlib.sha256(data).hexdigest()


def test_two_bytes_a_sample():
    text = b"plain words of a text, and more of them " * 16
    (film,) = a.films([text])
    _, _, places = a.parse_film(film)
    found, scan = a.frame(film[places[0][0] : sum(places[0])])
    assert len(scan) == len(found.blocks) * (2 * a.WIDTH + 2) and len(places) == 2


def test_whole_table(docs, texts):
    out = a.decode(a.encode(docs)).collect()
    assert len(out) == len(texts)
    for r in out:
        p = stored(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((texts[r["doc_id"]] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["clips"] and r["clips"][0]["start_s"] == 0
    for m in a.encode(docs.where("doc_id < 3")).collect():
        row = next(r for r in out if r["doc_id"] == m["doc_id"])
        assert (row["media_bytes"], row["media_sha256"]) == (len(m["media"]), hashlib.sha256(m["media"]).hexdigest())


def test_shots():
    dark, light = np.full((64, 64), 10), np.full((64, 64), 200)
    frames = np.stack([dark, dark + 1, light, light, light + 1, dark]).astype(np.uint8)
    assert a.shots(frames) == [0, 2, 5]
    assert a.shots(frames[:1]) == [0]
    noise = np.random.default_rng(1).integers(0, 256, (9, 64, 64)).astype(np.uint8)
    assert a.shots(noise) == [0]


def test_clips_are_timed_rows(spark):
    text = "\x01" * 512 * 3 + "~" * 512 * 2
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = a.clips(a.decode(a.encode(df))).orderBy("clip").collect()
    assert [(r["start_s"], r["end_s"], r["frames"]) for r in rows] == [(0.0, 0.12, 3), (0.12, 0.2, 2)]


class Bits:
    def __init__(self):
        self.text = ""

    def code(self, table, symbol):
        code, k = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                if table[k] == symbol:
                    self.text += format(code, f"0{n}b")
                    return
                code, k = code + 1, k + 1
            code *= 2
        raise KeyError(symbol)

    def value(self, v):
        n = abs(v).bit_length()
        self.text += format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def bytes(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return b"".join(bytes([int(text[i : i + 8], 2)]) + (b"\0" if text[i : i + 8] == "1" * 8 else b"") for i in range(0, len(text), 8))


ORDER = [0]  # coefficients along the diagonals, turning at the edges
while len(ORDER) < 64:
    y, x = divmod(ORDER[-1], 8)
    if (x + y) % 2 == 0:
        ORDER.append(8 * (y - 1) + x + 1 if x < 7 and y else 8 * y + x + 1 if x < 7 else 8 * (y + 1) + x)
    else:
        ORDER.append(8 * (y + 1) + x - 1 if y < 7 and x else 8 * (y + 1) + x if y < 7 else 8 * y + x + 1)

DC = bytes([0, 0, 1, 11, *[0] * 12, *range(12)])
AC = bytes([0] * 7 + [255] + [0] * 8) + bytes(r << 4 | n for r in range(16) for n in range(16))[:255]


def picture(blocks, h, w, comps, interval, quants):
    """A baseline picture from scalar code: ``blocks`` are zigzag coefficients in stored order,
    ``comps`` (across, down, quantiser) each."""
    seg = lambda m, d: bytes([255, m]) + (len(d) + 2).to_bytes(2, "big") + d
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + b"".join(seg(0xDB, bytes([i, *q])) for i, q in enumerate(quants))
    out += seg(0xC4, b"\x00" + DC + b"\x10" + AC)
    out += seg(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([i + 1, c[0] << 4 | c[1], c[2]]) for i, c in enumerate(comps)))
    out += seg(0xDD, interval.to_bytes(2, "big")) if interval else b""
    out += seg(0xDA, bytes([len(comps)]) + b"".join(bytes([i + 1, 0]) for i in range(len(comps))) + bytes([0, 63, 0]))
    pattern = [i for i, (x, y, _) in enumerate(comps) for _ in range(x * y)] if len(comps) > 1 else [0]
    units, marker = len(blocks) // len(pattern), 0
    for first in range(0, units, interval or units):
        bits, level = Bits(), [0] * len(comps)
        for b in range(first * len(pattern), min(first + (interval or units), units) * len(pattern)):
            c, z = pattern[b % len(pattern)], blocks[b]
            bits.code(DC, abs(z[0] - level[c]).bit_length())
            bits.value(z[0] - level[c])
            level[c], zeros = z[0], 0
            last = max((i for i in range(64) if z[i]), default=0)
            for v in z[1 : last + 1]:
                if v == 0:
                    zeros += 1
                    continue
                while zeros > 15:
                    bits.code(AC, 0xF0)
                    zeros -= 16
                bits.code(AC, zeros << 4 | abs(v).bit_length())
                bits.value(v)
                zeros = 0
            if last < 63:
                bits.code(AC, 0)
        out += bits.bytes()
        out += bytes([255, 0xD0 + marker % 8]) if first + (interval or units) < units else b""
        marker += 1
    return out + b"\xff\xd9"


def plain_pixels(z, quant):
    """One block by the defining sum."""
    f = np.zeros((8, 8))
    for i, v in enumerate(z):
        f[divmod(ORDER[i], 8)] = v * quant[i]
    scale = lambda u: 0.5**0.5 if u == 0 else 1.0
    return np.array([[sum(scale(u) * scale(v) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for x in range(8)] for y in range(8)])


@pytest.mark.parametrize("comps, interval", [([(1, 1, 0)], 0), ([(1, 1, 0)], 2), ([(2, 2, 0), (1, 1, 1), (1, 1, 1)], 0), ([(2, 1, 0), (1, 1, 1), (1, 1, 1)], 1)])
def test_pictures_of_other_makers(comps, interval):
    """Frames from scalar code, with AC coefficients, colour, sampling and sizes that fill no block."""
    rng = np.random.default_rng(len(comps) + interval)
    across, down = max(c[0] for c in comps), max(c[1] for c in comps)
    h, w = 21, 30
    columns, rows = -(-w // (8 * across)), -(-h // (8 * down))
    pattern = [i for i, (x, y, _) in enumerate(comps) for _ in range(x * y)]
    quants = [list(range(3, 67)), [9] * 64]
    blocks = []
    for _ in range(columns * rows * len(pattern)):
        z = [0] * 64
        z[0] = int(rng.integers(-90, 90))
        for i in rng.integers(1, 64, rng.integers(0, 6)):
            z[int(i)] = int(rng.integers(-3, 4))
        blocks.append(z)
    blocks[1][63], blocks[0][40] = 1, -300
    data = picture(blocks, h, w, comps, interval, quants)
    film = a.film(0, [data, data], 1).replace(b"payload", b"comment")
    stored, _, places = a.parse_film(film)
    heads, scans = zip(*[a.frame(film[s : s + n]) for s, n in places], strict=True)
    want = np.zeros((rows * down * 8, columns * across * 8))
    b = iter(blocks)
    for r in range(rows):
        for c in range(columns):
            for i, (x, y, q) in enumerate(comps):
                for k in range(x * y):
                    own = plain_pixels(next(b), quants[q])
                    if i == 0:
                        top, left = (r * down + k // x) * 8, (c * across + k % x) * 8
                        want[top : top + 8, left : left + 8] = own
    want = np.clip(want[:h, :w] + 128, 0, 255)
    for shown, flat in a.pictures(list(heads), list(scans)):
        assert not flat and shown.shape == (h, w) and np.abs(shown - want).max() <= 0.5 + 1e-6
    row = a._read([film])[0]
    assert stored == -1 and row[:3] == (None, None, None) and row[4] == hashlib.sha256(film).hexdigest()
    assert [(x["start_s"], x["end_s"]) for x in row[5]] == [(0.0, 0.08)] and abs(row[5][0]["mean"] - np.rint(want).mean()) < 1e-3


def plain_feature(text):
    """The feature from the payload alone."""
    data = stored(text)
    height = min(len(data) // 64, 8)
    size = 64 * height
    frames = [list(data[i : i + size].ljust(size, b"\0")) for i in range(0, len(data), size)]
    hist = [Counter(x // 16 for x in f) for f in frames]
    change = [sum(abs(p[b] - q[b]) for b in range(16)) / size / 2 for p, q in itertools.pairwise(hist)]
    cuts = [0]
    for i in range(1, len(frames)):
        past = change[max(cuts[-1], i - 9) : i - 1]
        if change[i - 1] > max(0.25, statistics.fmean(past) + 3 * statistics.pstdev(past) if past else 0):
            cuts.append(i)
    ends = [*cuts[1:], len(frames)]
    mean = [sum(map(sum, frames[x:y])) / size / (y - x) for x, y in zip(cuts, ends, strict=True)]
    return [(x / 25, y / 25, m) for x, y, m in zip(cuts, ends, mean, strict=True)]


def test_clips_against_plain_code(docs, texts):
    out = a.decode(a.encode(docs)).collect()
    for r in out:
        assert [(c["start_s"], c["end_s"]) for c in r["clips"]] == [x[:2] for x in plain_feature(texts[r["doc_id"]])]
        assert [c["mean"] for c in r["clips"]] == pytest.approx([x[2] for x in plain_feature(texts[r["doc_id"]])], abs=1e-5)
    frames = [sum(c["frames"] for c in r["clips"]) for r in out]
    assert statistics.median(frames) > 1 and max(len(r["clips"]) for r in out) > 1


def test_damaged_films(spark):
    (film,) = a.films([b"x" * 640])
    broken = [None, b"", b"RIFF", film[:200], film[:-40], film, film.replace(b"\xff\xc0", b"\xff\xc2"), film.replace(b"\xff\xd1", b"\xff\x00")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(broken)], "doc_id long, media binary")
    out = {r["doc_id"]: r["payload_bytes"] for r in a.decode(df).collect()}
    assert out[5] == 640 and [out[i] for i in (0, 1, 2, 3, 6, 7)] == [None] * 6


def test_edges(edge, clashing, empty, rows):
    from pyspark.sql import functions as F

    out = a.decode(a.encode(edge))
    assert {r["payload_sha256"] for r in out.where("doc_id in (2, 3)").collect()} == {hashlib.sha256(bytes(64)).hexdigest()}
    assert rows(a.decode(a.encode(clashing))) == rows(out)
    assert a.decode(a.encode(empty)).count() == 0
    assert out.select(a.feature(F.col("clips")).alias("f")).where("f is null").count() == 0
