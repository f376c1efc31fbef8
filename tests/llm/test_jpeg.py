"""The JPEG reader against a plain bit-by-bit writer, and the writer's round trip."""

import os
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pricewright.llm import jpeg

AC_BITS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)


@given(st.lists(st.binary(min_size=1, max_size=2000), min_size=1, max_size=8))
@settings(max_examples=40, deadline=None)
def test_round_trip(texts):
    payloads = [t + b"\0" * (-len(t) % 64) for t in texts]
    found = jpeg.thumbnails(jpeg.encode(payloads))
    assert [f[0][2].tobytes() for f in found] == payloads


def test_long_payload_goes_on_in_further_images():
    payload = os.urandom(64 * (jpeg.MAX_ROWS + 5))
    (found,) = jpeg.thumbnails(jpeg.encode([payload]))
    assert len(found) == 2 and b"".join(t.tobytes() for *_, t in found) == payload


class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        if n:
            self.bits += format(value, f"0{n}b")

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def done(self):
        self.bits += "1" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8)).replace(b"\xff", b"\xff\x00")


def plain_jpeg(rng, width, height, samplings, interval, quantizer):
    """A random image of DC and AC coefficients, and its luminance DC grid."""
    values = [run << 4 | size for run in range(4) for size in range(1, 6)] + [0x00, 0xF0]
    ac_bits = (0, 0, 0, 0, len(values)) + (0,) * 11
    dc_codes, ac_codes = jpeg._codes(jpeg.DC_BITS, jpeg.DC_VALUES), jpeg._codes(ac_bits, values)
    h0, v0 = samplings[0]
    if len(samplings) == 1:
        h0 = v0 = 1
        units, samplings_used = (-(-width // 8), -(-height // 8)), [(1, 1)]
    else:
        units, samplings_used = (-(-width // (8 * h0)), -(-height // (8 * v0))), samplings
    grid = np.zeros((units[1] * v0, units[0] * h0), int)
    scan, bits, previous, k = b"", Bits(), [0] * len(samplings), 0
    for y in range(units[1]):
        for x in range(units[0]):
            if interval and k and k % interval == 0:
                scan += bits.done() + bytes((0xFF, 0xD0 + (k // interval - 1) % 8))
                bits, previous = Bits(), [0] * len(samplings)
            k += 1
            for c, (h, v) in enumerate(samplings_used):
                for by in range(v):
                    for bx in range(h):
                        dc = rng.randint(-60, 60)
                        d, previous[c] = dc - previous[c], dc
                        bits.put(*dc_codes[abs(d).bit_length()])
                        bits.number(d)
                        if c == 0:
                            grid[y * v0 + by, x * h0 + bx] = dc
                        at = 1
                        while at < 64 and rng.random() < 0.6:
                            run, value = rng.randint(0, 3), rng.choice([-17, -3, -1, 1, 2, 30])
                            if rng.random() < 0.05 and at + 16 < 64:
                                bits.put(*ac_codes[0xF0])
                                at += 16
                                continue
                            if at + run >= 64:
                                break
                            bits.put(*ac_codes[run << 4 | abs(value).bit_length()])
                            bits.number(value)
                            at += run + 1
                        if at < 64:
                            bits.put(*ac_codes[0])
    scan += bits.done()
    parts = b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(samplings))
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes((len(samplings),)) + parts
    scans = bytes((len(samplings),)) + b"".join(bytes((c + 1, 0)) for c in range(len(samplings))) + b"\x00\x3f\x00"
    head = [
        b"\xff\xd8",
        jpeg._segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
        jpeg._segment(0xDB, b"\x00" + bytes((quantizer,)) + b"\x03" * 63),
        jpeg._segment(0xC0, frame),
        jpeg._segment(0xC4, b"\x00" + bytes(jpeg.DC_BITS) + bytes(jpeg.DC_VALUES)),
        jpeg._segment(0xC4, b"\x10" + bytes(ac_bits) + bytes(values)),
    ]
    if interval:
        head.append(jpeg._segment(0xDD, interval.to_bytes(2, "big")))
    want = np.clip((grid * quantizer + 4) // 8 + 128, 0, 255)
    return b"".join([*head, jpeg._segment(0xDA, scans), scan, b"\xff\xd9"]), want


def test_any_baseline_image():
    rng, files, want = random.Random(11), [], []
    for samplings in ([(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3):
        for interval in (0, 3):
            for width, height in ((8, 8), (50, 33), (17, 90)):
                made, grid = plain_jpeg(rng, width, height, samplings, interval, 5)
                files.append(made)
                want.append((width, height, grid))
    for (width, height, grid), found in zip(want, jpeg.thumbnails(files), strict=True):
        assert found[0][:2] == (width, height)
        assert (found[0][2] == grid).all()


def test_one_broken_file_spoils_no_other():
    good, _ = plain_jpeg(random.Random(1), 40, 40, [(1, 1)], 0, 8)
    found = jpeg.thumbnails([good, good[: len(good) // 2] + b"\xff\xd9", b"", good[:30], good])
    assert found[0] is not None and found[4] is not None and found[2] is None and found[3] is None
