"""Baseline JPEG in numpy: a writer for DC-only images and a DC thumbnail reader.

The writer stores a byte as the DC coefficient of one 8x8 block. With a quantizer of
8 a block of level v has the coefficient v - 128 exactly, so the byte is read back
without loss. Every row of 64 blocks is a restart interval.

The reader takes any baseline JPEG: it parses the markers, decodes the Huffman
codes of the scan and rebuilds the luminance thumbnail (one sample per block) from
the DC coefficients. Restart intervals are independent, so those of many images with
the same tables are decoded in lockstep, one numpy step per code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: The luminance DC code lengths and values of the JPEG standard's
#: Annex K, and an AC table with end-of-block as its only code.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
AC_BITS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_VALUES = (0,)

ROW = 64  # payload bytes, and blocks, of a restart interval
MAX_ROWS = 65535 // 8


def _codes(bits, values) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: value -> (code, length)."""
    code, out, k = 0, {}, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code += 1
            k += 1
        code <<= 1
    return out


def _lookup(bits, values) -> np.ndarray:
    """By the next 16 bits: code length << 8 | value; 0 where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    for value, (code, length) in _codes(bits, values).items():
        low = code << (16 - length)
        table[low : low + (1 << (16 - length))] = length << 8 | value
    return table


def _block_words() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference + 255: the whole block's bits, left-aligned in 16, and how
    many they are."""
    dc, (_, eob_length) = _codes(DC_BITS, DC_VALUES), _codes(AC_BITS, AC_VALUES)[0]
    words, lengths = np.zeros(511, np.uint16), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        total = length + size + eob_length
        words[d + 255] = (code << size | extra) << (16 - length - size)
        lengths[d + 255] = total
    return words, lengths


WORDS, LENGTHS = _block_words()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    size = (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big")
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x08" + b"\x01" * 63),
            _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00"),
            _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_VALUES) + b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES)),
            _segment(0xDD, ROW.to_bytes(2, "big")),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as JPEG images, 64 blocks
    wide; one that exceeds a JPEG's height goes on in further images behind it."""
    rows = np.array([len(p) // ROW for p in payloads])
    levels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    differences = np.diff(levels, axis=1, prepend=np.int16(0)) + 255
    words, lengths = WORDS[differences], LENGTHS[differences]
    used = lengths.sum(axis=1)
    fill = (-used) % 8
    words = np.concatenate([words, np.full((len(words), 1), 0xFFFF, np.uint16)], axis=1)
    lengths = np.concatenate([lengths, fill[:, None]], axis=1)
    bits = np.unpackbits(words.ravel().astype(">u2").view(np.uint8)).reshape(-1, 16)
    packed = np.packbits(bits[np.arange(16) < lengths.reshape(-1, 1)])
    # byte stuffing, and a restart marker behind every row that is not its image's last
    row_end = np.cumsum((used + fill) // 8)
    in_payload = np.arange(len(levels)) - np.repeat(np.cumsum(rows) - rows, rows)
    in_image = in_payload % MAX_ROWS
    last = (in_image == MAX_ROWS - 1) | (in_payload == np.repeat(rows, rows) - 1)
    counts = 1 + (packed == 0xFF).astype(np.int64)
    counts[row_end - 1] += 2 * ~last
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - counts] = packed
    out[ends[row_end - 1][~last] - 2] = 0xFF
    out[ends[row_end - 1][~last] - 1] = 0xD0 + in_image[~last] % 8
    stop, stream, made, r = ends[row_end - 1], out.tobytes(), [], 0
    for n in rows.tolist():
        parts = []
        for first in range(0, n, MAX_ROWS):
            m = min(MAX_ROWS, n - first)
            begin = int(stop[r - 1]) if r else 0
            parts += [_head(m), stream[begin : int(stop[r + m - 1])], b"\xff\xd9"]
            r += m
        made.append(b"".join(parts))
    return made


class Unsupported(ValueError):
    """Not a baseline JPEG that this reader can decode."""


@dataclass
class Image:
    """A parsed image: its size, what its scan needs, and the scan's intervals."""

    width: int
    height: int
    components: list  # (h, v, DC table, AC table, DC quantizer)
    mcus_wide: int
    mcus_high: int
    interval: int
    bounds: list = field(default_factory=list)  # (start, end) bytes of each interval

    @property
    def tables(self) -> tuple:
        return tuple((h, v, dc, ac) for h, v, dc, ac, _ in self.components)


def parse(data: bytes, start: int = 0) -> tuple[Image, int]:
    """The image that begins at ``start``, and where it ends."""
    if data[start : start + 2] != b"\xff\xd8":
        raise Unsupported("no start of image")
    quantizers, huffman, frame, interval, at = {}, {}, None, 0, start + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise Unsupported("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4, body[i] & 15
                quantizers[name] = int.from_bytes(body[i + 1 : i + 2 + (wide > 0)], "big")
                i += 1 + 64 * (1 + (wide > 0))
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                bits = tuple(body[i + 1 : i + 17])
                n = sum(bits)
                huffman[body[i]] = (bits, tuple(body[i + 17 : i + 17 + n]))
                i += 17 + n
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise Unsupported("samples are not of 8 bits")
            frame = (
                int.from_bytes(body[3:5], "big"),
                int.from_bytes(body[1:3], "big"),
                {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])},
            )
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Unsupported("not baseline")
        elif marker == 0xDA:
            break
    if not frame or not frame[0] or not frame[1]:
        raise Unsupported("no frame size")
    width, height, named = frame
    parts = []
    for i in range(body[0]):
        h, v, q = named[body[1 + 2 * i]]
        t = body[2 + 2 * i]
        parts.append((h, v, huffman[t >> 4], huffman[16 | t & 15], quantizers[q]))
    if body[1] != next(iter(named)):
        raise Unsupported("the first scan has no luminance")
    widest, highest = max(h for h, _, _ in named.values()), max(v for _, v, _ in named.values())
    if len(parts) == 1:  # not interleaved: one block is one unit
        h, v, *rest = parts[0]
        wide, high = -(-width * h // widest), -(-height * v // highest)
        parts, units = [(1, 1, *rest)], (-(-wide // 8), -(-high // 8))
    else:
        units = -(-width // (8 * widest)), -(-height // (8 * highest))
    image = Image(width, height, parts, *units, interval)
    begin = at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise Unsupported("the scan does not end")
        code = data[at + 1]
        if 0xD0 <= code <= 0xD7:
            image.bounds.append((begin, at))
            begin = at + 2
        elif code:
            image.bounds.append((begin, at))
            break
        at += 2
    end = data.find(b"\xff\xd9", at)
    if end < 0:
        raise Unsupported("no end of image")
    return image, end + 2



def _luminance(stream: np.ndarray, starts: np.ndarray, units: np.ndarray, tables: tuple) -> np.ndarray:
    """DC coefficients of the first component: [interval, unit, block]. ``stream``
    has no stuffing; ``starts`` are bytes; ``units`` is sorted, most first."""
    padded = np.concatenate([stream, np.full(16, 0xFF, np.uint8)]).astype(np.uint64)
    ahead = np.zeros(len(stream) + 8, np.uint64)  # 64 bits from each byte on
    for k in range(8):
        ahead |= padded[k : k + len(ahead)] << np.uint64(56 - 8 * k)
    lookups = {t: _lookup(*t) for c in tables for t in c[2:]}
    first = tables[0][0] * tables[0][1]
    out = np.zeros((len(starts), int(units[0]), first), np.int32)
    at = starts * 8
    previous = np.zeros((len(tables), len(starts)), np.int64)
    limit = len(ahead) - 1

    def window(p):
        return ahead[np.minimum(p >> 3, limit)] << (p & 7).astype(np.uint64)

    for unit in range(int(units[0])):
        n = int(np.searchsorted(-units, -unit, "left"))  # intervals with this unit
        for c, (h, v, dc, ac) in enumerate(tables):
            for block in range(h * v):
                bits = window(at[:n])
                found = lookups[dc][(bits >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                length, size = found >> 8, found & 255
                if not length.all() or size.max(initial=0) > 11:
                    raise Unsupported("no such code")
                bits <<= length.astype(np.uint64)
                extra = ((bits >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
                half = (1 << size) >> 1
                previous[c, :n] += np.where(extra < half, extra - (1 << size) + 1, extra)
                if c == 0:
                    out[:n, unit, block] = previous[0, :n]
                bits <<= size.astype(np.uint64)
                found = lookups[ac][(bits >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                at[:n] += length + size
                if not (found & 255).any() and found.all():  # all blocks end here
                    at[:n] += found >> 8
                    continue
                left, k = np.arange(n), np.ones(n, np.int64)
                while len(left):
                    found = lookups[ac][(window(at[left]) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                    length, run, size = found >> 8, (found >> 4) & 15, found & 15
                    if not length.all():
                        raise Unsupported("no such code")
                    at[left] += length + size
                    k += np.where((size == 0) & (run < 15), 64, run + 1)
                    more = k < 64
                    left, k = left[more], k[more]
    return out


def _decode_alike(data: list[bytes], images: list[Image]) -> list[np.ndarray]:
    """Thumbnails of images that have the same tables."""
    streams, starts, units, base = [], [], [], 0
    for raw, image in zip(data, images, strict=True):
        total = image.mcus_wide * image.mcus_high
        step = image.interval or total
        if len(image.bounds) != -(-total // step):
            raise Unsupported("restart markers do not fit the size")
        a = np.frombuffer(raw, np.uint8)[image.bounds[0][0] : image.bounds[-1][1]]
        keep = np.ones(len(a), bool)
        after = np.zeros(len(a), bool)
        after[1:] = a[:-1] == 0xFF
        keep[after & (a == 0)] = False
        begin = np.array([b for b, _ in image.bounds]) - image.bounds[0][0]
        ends = np.array([e for _, e in image.bounds[:-1]], np.int64) - image.bounds[0][0]
        keep[ends] = keep[ends + 1] = False
        index = np.cumsum(keep) - keep
        streams.append(a[keep])
        starts.append(index[begin] + base)
        base += len(streams[-1])
        sizes = np.full(len(begin), step)
        sizes[-1] = total - step * (len(begin) - 1)
        units.append(sizes)
    starts, units = np.concatenate(starts), np.concatenate(units)
    order = np.argsort(-units, kind="stable")
    coefficients = np.empty((len(starts), int(units.max()), 0), np.int32)
    found = _luminance(np.concatenate(streams), starts[order], units[order], images[0].tables)
    coefficients = np.empty_like(found)
    coefficients[order] = found
    out, row = [], 0
    for image in images:
        n, (h, v, *_, q) = len(image.bounds), image.components[0]
        total = image.mcus_wide * image.mcus_high
        step = image.interval or total
        dc = coefficients[row : row + n, :step].reshape(-1, h * v)[:total]
        row += n
        grid = dc.reshape(image.mcus_high, image.mcus_wide, v, h).swapaxes(1, 2)
        grid = grid.reshape(image.mcus_high * v, image.mcus_wide * h)
        out.append(np.clip((grid * q + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def thumbnails(files: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """Of each file its images' (width, height, luminance thumbnail); None if the
    file is null or cannot be decoded as baseline JPEG."""
    parsed: list = []
    alike: dict[tuple, list] = {}
    for i, raw in enumerate(files):
        found, at = [], 0
        try:
            while raw and at < len(raw):
                image, at = parse(raw, at)
                found.append(image)
        except (Unsupported, KeyError, IndexError):
            found = []
        parsed.append(found)
        for k, image in enumerate(found):
            alike.setdefault((image.tables, image.interval), []).append((i, k))
    made: dict[tuple[int, int], np.ndarray | None] = {}
    for members in alike.values():
        try:
            got = _decode_alike([files[i] for i, _ in members], [parsed[i][k] for i, k in members])
        except (Unsupported, IndexError):  # find the broken ones
            got = []
            for i, k in members:
                try:
                    got += _decode_alike([files[i]], [parsed[i][k]])
                except (Unsupported, IndexError):
                    got.append(None)
        made.update(zip(members, got, strict=True))
    out: list = []
    for i, found in enumerate(parsed):
        own = [(im.width, im.height, made[i, k]) for k, im in enumerate(found)]
        out.append(own if own and all(t is not None for *_, t in own) else None)
    return out
