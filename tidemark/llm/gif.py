"""Media columns: GIF files of timed frames, their LZW code streams decoded and composed, with colour histograms.

`decode_many` reads any GIFs of 8-bit samples: global and local palettes, interlacing, transparency, disposal and delays.
`encode_many` writes frames with a palette, dictionary codes and, where a sample value is free to stand for it, transparency
for what doesn't change from frame to frame. Code streams are written and read for many frames at once: each step takes
the next sample, or the next code, of all of them, with a table for each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
PIXELS = SIDE * SIDE
DELAY_CS = 10
#: Samples after which a code table starts anew, so that it can't be full.
RUN = 3800
#: Frames whose streams are written or read at once; bounds their tables.
LANES = 1024
#: Pixels of a canvas or frame that are read; more is an error of that file.
MOST_PIXELS = 1 << 24
#: A colour for each sample value: red is the value itself, green and blue are spread.
PALETTE = np.array([(i, i * 151 % 256, i * 211 % 256) for i in range(256)], np.uint8)
BINS = 8


def _codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LZW codes of rows of 8-bit samples (at most RUN), and their number a row. A hashed table a row: (code, next sample) to code."""
    n, pixels = rows.shape
    bits = max(4, (2 * pixels - 1).bit_length())
    mask = (1 << bits) - 1
    keys, values = np.zeros(n << bits, np.int32), np.zeros(n << bits, np.int32)
    base = np.arange(n, dtype=np.int64) << bits
    out, count = np.zeros((n, pixels), np.int32), np.zeros(n, np.int64)
    samples = np.ascontiguousarray(rows.T).astype(np.int64)
    now = samples[0]
    for sample in samples[1:]:
        key = (now << 8 | sample) + 1
        slot = base + (key * 2654435761 >> 15 & mask)
        held = keys[slot]
        probing = np.flatnonzero((held != key) & (held != 0))
        while len(probing):
            at = slot[probing]
            at = at & ~mask | at + 1 & mask
            slot[probing] = at
            held[probing] = keys[at]
            probing = probing[(held[probing] != key[probing]) & (held[probing] != 0)]
        hit = held == key
        new = np.flatnonzero(~hit)
        out[new, count[new]] = now[new]
        at = slot[new]
        keys[at], values[at] = key[new], 258 + count[new]
        count[new] += 1
        now = np.where(hit, values[slot], sample)
    out[np.arange(n), count] = now
    return out, count + 1


def lzw_encode_many(rows: np.ndarray) -> list[bytes]:
    """Code streams of rows of 8-bit samples, each with a clear code at first and after every RUN samples, and an end code."""
    n = len(rows)
    codes, widths, used = [np.full((n, 1), 256)], [np.full((n, 1), 9)], [np.ones((n, 1), bool)]
    for a in range(0, rows.shape[1], RUN):
        own, count = _codes(rows[:, a : a + RUN])
        j = np.arange(own.shape[1] + 1)
        wide = 9 + (j >= 255) + (j >= 767) + (j >= 1791)  # the table's size follows from the number of codes alone
        last = 257 if a + RUN >= rows.shape[1] else 256
        codes.append(np.where(j < count[:, None], np.append(own, np.zeros((n, 1), own.dtype), axis=1), last))
        widths.append(np.broadcast_to(wide, codes[-1].shape))
        used.append(j <= count[:, None])
    code, width, held = (np.concatenate(x, axis=1) for x in (codes, widths, used))
    width = np.where(held, width, 0)
    ends = np.cumsum(width, axis=1)
    size = -(-ends[:, -1] // 8)
    first = np.cumsum(size) - size
    at = (ends - width)[held]
    value = code[held].astype(np.int64) << (at & 7)
    where = np.repeat(first, held.sum(1)) + (at >> 3)
    total = int(size.sum()) + 2
    data = sum(np.bincount(where + k, value >> 8 * k & 255, total) for k in range(3)).astype(np.uint8).tobytes()
    return [data[f : f + s] for f, s in zip(first.tolist(), size.tolist(), strict=True)]


def lzw_many(streams: list[bytes], least: int, pixels: int) -> np.ndarray:
    """Samples, a row for each code stream and at most `pixels`; what a stream doesn't give is 0. A code that no table holds is an error.

    Every string of a table is a part of the samples before it, so a table holds places and lengths; samples are
    read from where they were first written, over as many steps as such places follow one another."""
    n, clear = len(streams), 1 << least
    top, stride = min(4096, clear + 3 + pixels), pixels + 1
    raw = np.frombuffer(b"".join([s + b"\0\0\0" for s in streams]), np.uint8).astype(np.int64)
    size = np.array([len(s) for s in streams], np.int64)
    bit = 8 * (np.cumsum(size + 3) - size - 3)
    end = bit + 8 * size
    place, length = np.zeros((n, top), np.int64), np.zeros((n, top), np.int64)
    width, following = np.full(n, least + 1), np.full(n, clear + 2)
    pos, before, before_len = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    literal, copies, live = [], [], np.arange(n)
    while True:
        live = live[(bit[live] + width[live] <= end[live]) & (pos[live] < pixels)]
        if not len(live):
            break
        at, w = bit[live], width[live]
        byte = at >> 3
        code = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7) & (1 << w) - 1
        bit[live] += w
        anew = live[code == clear]
        width[anew], following[anew], before_len[anew] = least + 1, clear + 2, 0
        live, taken, given = live[code != clear + 1], (code != clear) & (code != clear + 1), live
        d, c = given[taken], code[taken]
        if not len(d):
            continue
        p, f, b, bl = pos[d], following[d], before[d], before_len[d]
        if ((c > f) | (c == f) & (bl == 0)).any():
            raise ValueError("a code that the table doesn't hold")
        known, single = c < f, c < clear
        inside = np.minimum(c, top - 1)
        source = np.where(single, p, np.where(known, place[d, inside], b))
        long_ = np.where(single, 1, np.where(known, length[d, inside], bl + 1))
        grows = (bl > 0) & (f < 4096)
        g, at = d[grows], f[grows]
        place[g, at], length[g, at] = b[grows], bl[grows] + 1
        f = f + grows
        following[d], before[d], before_len[d] = f, p, long_
        width[d] += (f == 1 << width[d]) & (width[d] < 12)
        literal.append((d[single] * stride + p[single], c[single]))
        more = ~single
        copies.append((d[more] * stride, p[more], source[more], np.minimum(long_, pixels - p)[more]))
        pos[d] = np.minimum(p + long_, pixels)
    out, origin = np.zeros(n * stride, np.uint8), np.arange(n * stride)
    if literal:
        out[np.concatenate([x for x, _ in literal])] = np.concatenate([c for _, c in literal])
        lane, p, source, long_ = (np.concatenate(x) for x in zip(*copies, strict=True))
        step = np.arange(int(long_.sum())) - np.repeat(np.cumsum(long_) - long_, long_)
        origin[np.repeat(lane + p, long_) + step] = np.repeat(lane + source, long_) + step
        while True:
            back = origin[origin]
            if (back == origin).all():
                break
            origin = back
    return out[origin].reshape(n, stride)[:, :pixels]


def encode_many(films: list[np.ndarray], palette: np.ndarray = PALETTE, delay_cs: int = DELAY_CS) -> list[bytes]:
    """A GIF for each array of frames (n, height, width) of 8-bit palette indices; all of one height and width.

    Pixels that stay as in the frame before are written as a value that the film doesn't use, marked transparent, and frames
    are left in place; a film that uses all values has no transparency."""
    if not films:
        return []
    _, height, width = films[0].shape
    drawn, free = [], []
    for film in films:
        unused = np.flatnonzero(np.bincount(film.reshape(-1), minlength=256) == 0)
        free.append(int(unused[-1]) if len(unused) and len(film) > 1 else -1)
        own = film.reshape(len(film), -1)
        if free[-1] >= 0:
            own = own.copy()
            own[1:][film.reshape(own.shape)[1:] == film.reshape(own.shape)[:-1]] = free[-1]
        drawn.append(own)
    rows = np.concatenate(drawn)
    streams = [s for a in range(0, len(rows), LANES) for s in lzw_encode_many(rows[a : a + LANES])]
    made, at = [], 0
    head = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + palette.tobytes() + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    place = b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08"
    for film, clear in zip(films, free, strict=True):
        parts = [head]
        for k in range(len(film)):
            see = clear >= 0 and k > 0
            parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2 | see, delay_cs, clear if see else 0, 0) + place)
            data = streams[at + k]
            for a in range(0, len(data), 255):
                parts += (bytes([min(255, len(data) - a)]), data[a : a + 255])
            parts.append(b"\x00")
        at += len(film)
        made.append(b"".join(parts) + b"\x3b")
    return made


def encode(frames: np.ndarray, palette: np.ndarray = PALETTE, delay_cs: int = DELAY_CS) -> bytes:
    return encode_many([frames], palette, delay_cs)[0]


def parse(gif: bytes):
    """(width, height, background colour, images) of a file; an image is (disposal, delay, transparent index or -1), its place, interlacing, palette, least code size and code stream."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", gif[6:13])
    if width * height > MOST_PIXELS:
        raise ValueError("a canvas over the bound")
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        p = np.zeros((256, 3), np.uint8)
        if flags & 128:
            n = 2 << (flags & 7)
            p[:n] = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        return p

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := gif[at]:
            parts.append(gif[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = palette(flags)
    control, images = (0, 0, -1), []
    while at < len(gif) and gif[at] != 0x3B:
        mark = gif[at]
        at += 1
        if mark == 0x21:
            label, at = gif[at], at + 1
            data = blocks()
            if label == 0xF9:
                bits, delay, index = struct.unpack("<BHB", data[:4])
                control = (bits >> 2 & 7, delay, index if bits & 1 else -1)
        elif mark == 0x2C:
            x, y, w, h, bits = struct.unpack("<HHHHB", gif[at : at + 9])
            at += 9
            own = palette(bits) if bits & 128 else shared
            least, at = gif[at], at + 1
            if w * h > MOST_PIXELS or not 1 <= least <= 11:
                raise ValueError("a frame over the bound, or no code size")
            images.append((control, (x, y, w, h), bool(bits & 64), own, least, blocks()))
            control = (0, 0, -1)
        else:
            raise ValueError("an unknown block")
    return width, height, shared[background] if flags & 128 else np.zeros(3, np.uint8), images


def composed(parsed, samples: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """(canvas as shown, delay) of each frame in turn: samples put in their rows, coloured, laid over what is there, and disposed of after."""
    width, height, background, images = parsed
    canvas = np.zeros((height, width, 3), np.uint8)
    for ((disposal, delay, clear), (x, y, w, h), interlaced, own, _, _), index in zip(images, samples, strict=True):
        index = index.reshape(h, w)
        if interlaced:
            order = [r for a, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, step)]
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        before = canvas.copy() if disposal == 3 else None
        part = canvas[y : y + h, x : x + w]
        index = index[: part.shape[0], : part.shape[1]]
        if clear >= 0:
            solid = index != clear
            part[solid] = own[index[solid]]
        else:
            part[...] = own[index]
        yield canvas.copy(), delay
        if disposal == 2:
            canvas[y : y + h, x : x + w] = background
        elif disposal == 3:
            canvas = before


def decode_many(gifs: list[bytes]) -> list[tuple[np.ndarray, list[int]]]:
    """For each file its composed frames (n, height, width, 3) as they are shown, and their delays in hundredths of a second."""
    files = [parse(g) for g in gifs]
    kinds: dict[tuple[int, int], list] = {}
    samples = [[None] * len(f[3]) for f in files]
    for i, f in enumerate(files):
        for k, (_, (_, _, w, h), _, _, least, data) in enumerate(f[3]):
            kinds.setdefault((least, w * h), []).append((i, k, data))
    for (least, pixels), found in kinds.items():
        lanes = max(1, min(LANES, MOST_PIXELS // (pixels + 1)))
        for a in range(0, len(found), lanes):
            part = found[a : a + lanes]
            for (i, k, _), row in zip(part, lzw_many([x for _, _, x in part], least, pixels), strict=True):
                samples[i][k] = row
    out = []
    for f, own in zip(files, samples, strict=True):
        shown, delays = [], []
        for canvas, delay in composed(f, own):
            shown.append(canvas)
            delays.append(delay)
        out.append((np.array(shown, np.uint8).reshape(-1, f[1], f[0], 3), delays))
    return out


def decode(gif: bytes) -> tuple[np.ndarray, list[int]]:
    return decode_many([gif])[0]


def histogram(frames: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Pixels by channel (red, green, blue) and equal bins of brightness."""
    return np.concatenate([np.bincount(frames[..., c].reshape(-1) // (256 // bins), minlength=bins) for c in range(3)])


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 with bytes 255 up to a positive multiple of a frame's pixels, and its own length."""
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % PIXELS or (0 if data else PIXELS)), len(data)


def media(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """A GIF for each document and what its decoded frames show: doc_id, n_bytes, media (binary, if asked), media_bytes,
    media_sha256, n_frames, delays_cs, payload_bytes, payload_sha256 and tail_crc32 (of the samples read back) and
    histogram (pixels in eight bins of each channel over all frames).

    Null text: as empty, one frame of 255. Repeated rows repeat. Rows don't depend on one another: no shuffle."""
    rows = docs.select("doc_id", "text")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int32()), ("delay_cs", pa.int64()),
              ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("histogram", pa.list_(pa.int64()))]
    fields += [("media", pa.binary())] * with_bytes
    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, n_frames int, delay_cs long, payload_bytes long, payload_sha256 string, tail_crc32 long, histogram array<long>" + ", media binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):  # bounds what is held of one batch
                b = whole.slice(a, 256)
                texts = [payload(t) for t in b.column(1).to_pylist()]
                gifs = encode_many([np.frombuffer(data, np.uint8).reshape(-1, SIDE, SIDE) for data, _ in texts])
                out = []
                for doc, (_, n), gif, (shown, delays) in zip(b.column(0).to_pylist(), texts, gifs, decode_many(gifs), strict=True):
                    back = np.ascontiguousarray(shown[..., 0]).tobytes()  # red is the sample
                    row = (doc, n, len(gif), hashlib.sha256(gif).hexdigest(), len(delays), sum(delays), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), histogram(shown))
                    out.append(row + (gif,) * with_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[k for k, _ in fields])

    return rows.mapInArrow(run, schema)


def _timed(doc, data: bytes) -> Iterator[tuple]:
    start = 0
    try:
        file = parse(data)
        streams = (lzw_many([x], least, w * h)[0] for _, (_, _, w, h), _, _, least, x in file[3])
        for k, (x, delay) in enumerate(composed(file, streams)):
            yield (doc, k, start, delay, *x.shape[:2], x.tobytes(), histogram(x), None)
            start += delay
    except (ValueError, IndexError, struct.error) as e:
        yield (doc, None, None, None, None, None, None, None, str(e) or type(e).__name__)


def frames(docs: DataFrame, gif: str = "media") -> DataFrame:
    """Timed frames of the GIFs in a binary column: doc_id, frame, start_cs, delay_cs, height, width, rgb (binary), histogram.

    A null GIF gives no frames; where a file can't be read, or is over the bound of pixels, a row with a null frame and
    the error follows the frames read until then. Repeated rows give their frames again, and an empty table none."""
    schema = "doc_id long, frame int, start_cs long, delay_cs long, height int, width int, rgb binary, histogram array<long>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                for row in _timed(doc, data):  # a frame at a time, so that a long film isn't held
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=names)

    return docs.select("doc_id", F.col(gif).alias("media")).mapInArrow(run, schema)
