"""Lossless WebP (VP8L) in numpy: a decoder of the whole bitstream, and encoders.

``decode`` reads any lossless stream: simple and normal prefix codes, several prefix-code groups, length-distance
back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms.
``decode_batch`` decodes the grey levels of many streams at once, one lane each: prefix codes and back-references step
by step for all lanes together, then the inverse transforms. ``encode_batch`` writes such streams from grey images.
``encode`` writes single images with any mix of features.

Pixels are uint32 numbers 0xAARRGGBB.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format.
SIGNATURE, MAX_SIDE, HASH = 0x2F, 1 << 14, 0x1E35A7BD
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREENS, LITERALS, LENGTHS, DISTANCES = 280, 256, 24, 40
PREDICTOR, CROSS, SUBTRACT, PALETTE = 0, 1, 2, 3
#: The 120 short distance codes: neighbours by distance, then by |x|, positive x first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
BLACK = 0xFF000000


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.near, self.first = int.from_bytes(data[:64], "little"), 0

    def peek(self, n: int) -> int:
        ahead = self.at - self.first
        if ahead > 480:
            byte = self.at >> 3
            self.near, self.first = int.from_bytes(self.data[byte : byte + 64], "little"), byte << 3
            ahead = self.at & 7
        return self.near >> ahead & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends too early")
        value = self.peek(n)
        self.at += n
        return value


class Writer:
    """Bits to a byte string, least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0
        self.done = bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 1024:
            self.settle()

    def settle(self) -> None:
        """Whole bytes to ``done``."""
        whole = self.n >> 3
        self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
        self.value >>= 8 * whole
        self.n &= 7

    def bytes(self) -> bytes:
        self.settle()
        return bytes(self.done) + (bytes([self.value & 255]) if self.n else b"")


# Prefix codes


#: All 15-bit numbers with their bits in reverse.
REVERSED = (np.arange(1 << 15)[:, None] >> np.arange(15) & 1) @ (1 << np.arange(14, -1, -1))
REVERSED = REVERSED.tolist()


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code as it stands in the stream, its length); a lone symbol takes no bits."""
    if len(lengths) == 1:
        return {s: (0, 0) for s in lengths}
    codes, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        codes[s], last = (REVERSED[code] >> 15 - n, n), n
        code += 1
    if code != 1 << last:
        raise ValueError("a prefix code that is not complete")
    return codes


def table_of(lengths: dict[int, int], bits: int | None = None) -> tuple[np.ndarray, int]:
    """Look-up by the next ``bits`` bits: symbol << 4 | length."""
    bits = max(lengths.values(), default=0) if bits is None else bits
    table = np.zeros(1 << bits, np.uint16)
    for s, (code, n) in canonical(lengths).items():
        table[code :: 1 << n] = s << 4 | n
    return table, bits


def code_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Lengths of a prefix code for ``counts``, none over ``most``; rare symbols are raised until that holds."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    symbols, n = sorted(counts), len(counts)
    floor = 1 + (sum(counts.values()) >> most)
    while True:
        # Nodes are numbered leaves first; a joined node has a higher number than its parts.
        heap = [(max(counts[s], floor), k) for k, s in enumerate(symbols)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= most:
            return dict(zip(symbols, depth))
        floor *= 2


def write_code(out: Writer, lengths: dict[int, int], size: int) -> None:
    """A prefix code: the simple form for up to two small symbols, else run-length coded lengths."""
    symbols = sorted(lengths)
    if len(symbols) <= 2 and all(s < 256 for s in symbols):
        out.put(1, 1)
        out.put(max(0, len(symbols) - 1), 1)
        first = symbols[0] if symbols else 0
        out.put(int(first > 1), 1)
        out.put(first, 8 if first > 1 else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return
    steps, zeros, last = [], 0, -1
    for s in [*symbols, None]:
        zeros = (size if s is None else s) - last - 1
        if s is None:
            zeros = 0  # trailing zeros are left out by the count below
        while zeros >= 11:
            steps.append((18, min(zeros, 138) - 11, 7))
            zeros -= min(zeros, 138)
        if zeros >= 3:
            steps.append((17, zeros - 3, 3))
            zeros = 0
        steps += [(0, 0, 0)] * zeros
        if s is not None:
            steps.append((lengths[s], 0, 0))
            last = s
    inner = code_lengths(Counter(k for k, _, _ in steps), 7)
    codes = canonical(inner)
    listed = [inner.get(k, 0) for k in LENGTH_ORDER]
    n = max(4, max(i + 1 for i, x in enumerate(listed) if x))
    out.put(0, 1)
    out.put(n - 4, 4)
    for x in listed[:n]:
        out.put(x, 3)
    # The number of length symbols that follow, in the fewest even number of bits.
    width = next(w for w in range(2, 17, 2) if len(steps) - 2 < 1 << w)
    out.put(1, 1)
    out.put((width - 2) // 2, 3)
    out.put(len(steps) - 2, width)
    for k, extra, bits in steps:
        out.put(*codes[k])
        out.put(extra, bits)


def read_code(bits: Bits, size: int) -> dict[int, int]:
    """The lengths of a prefix code, by symbol."""
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths = {bits.read(8 if wide else 1): 1}
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    inner: dict[int, int] = {}
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        if n := bits.read(3):
            inner[k] = n
    table, width = table_of(inner)
    table = table.tolist()
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, s, last = {}, 0, 8
    while s < size and left:
        left -= 1
        entry = table[bits.peek(width)]
        bits.at += entry & 15
        k = entry >> 4
        if k < 16:
            if k:
                lengths[s], last = k, k
            s += 1
        elif k == 16:
            n = 3 + bits.read(2)
            lengths |= dict.fromkeys(range(s, s + n), last)
            s += n
        else:
            s += 3 + bits.read(3) if k == 17 else 11 + bits.read(7)
    if s > size or not lengths or bits.at > bits.end:
        raise ValueError("a prefix code that does not fit its alphabet")
    return lengths


# Entropy-coded images


def _symbol(bits: Bits, code: tuple[list[int], int]) -> int:
    entry = code[0][bits.peek(code[1])]
    bits.at += entry & 15
    return entry >> 4


def _prefixed(bits: Bits, code: int) -> int:
    """The value behind a length or distance code."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """The pixels of an entropy-coded image, in rows."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    groups, block, groups_of = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        groups_of = read_image(bits, -(-width >> block), -(-height >> block)) >> 8 & 0xFFFF
        groups = int(groups_of.max()) + 1
        across = -(-width >> block)
    codes = []
    for _ in range(groups):
        sizes = (GREENS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
        codes.append([(t.tolist(), n) for t, n in (table_of(read_code(bits, s)) for s in sizes)])
    cache = [0] * (1 << cache_bits)
    out, total = [], width * height
    recent = 0  # pixels up to here are in the colour cache
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, distance = codes[int(groups_of[(at // width >> block) * across + (at % width >> block)]) if groups_of is not None else 0]
        s = _symbol(bits, green)
        if s < LITERALS:
            r, b, a = _symbol(bits, red), _symbol(bits, blue), _symbol(bits, alpha)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < GREENS:
            length = _prefixed(bits, s - LITERALS)
            back = _prefixed(bits, _symbol(bits, distance))
            if back > len(NEAR):
                back -= len(NEAR)
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * width)
            if back > at or at + length > total:
                raise ValueError("a back-reference outside the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            for p in out[recent:]:
                cache[(HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            recent = at
            out.append(cache[s - GREENS])
        if cache_bits and len(out) - recent > 4096:
            for p in out[recent:]:
                cache[(HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            recent = len(out)
        if bits.at > bits.end:
            raise ValueError("the stream ends too early")
    return np.array(out, np.uint32)


# Transforms


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _sub(a: int, b: int) -> int:
    return _add(a, _add(~b & 0xFFFFFFFF, 0x01010101))


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(parts) -> int:
    a, r, g, b = (min(255, max(0, x)) for x in parts)
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction from the neighbours at the left, above, above right and above left."""
    if mode == 11:
        nearer = sum(abs(t - c) - abs(x - c) for x, t, c in zip(_parts(left), _parts(top), _parts(corner)))
        return left if nearer < 0 else top
    if mode == 12:
        return _joined(x + t - c for x, t, c in zip(_parts(left), _parts(top), _parts(corner)))
    if mode == 13:
        # The quotient is rounded towards zero.
        return _joined(m + int((m - c) / 2) for m, c in zip(_parts(_mean(left, top)), _parts(corner)))
    return (
        lambda: BLACK, lambda: left, lambda: top, lambda: right, lambda: corner,
        lambda: _mean(_mean(left, right), top), lambda: _mean(left, corner), lambda: _mean(left, top), lambda: _mean(corner, top), lambda: _mean(top, right),
        lambda: _mean(_mean(left, corner), _mean(top, right)),
    )[mode]() if mode < 11 else BLACK


def _neighbours(pixels: list[int], at: int, width: int, modes: list[int], block: int) -> int:
    """The prediction for the pixel at ``at`` from those before it."""
    y, x = divmod(at, width)
    if not at:
        return BLACK
    if not y:
        return pixels[at - 1]
    if not x:
        return pixels[at - width]
    mode = modes[(y >> block) * -(-width >> block) + (x >> block)] >> 8 & 15
    return predicted(mode, pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def undo_predictor(residuals: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray:
    used = np.unique(modes >> 8 & 15)
    if len(used) == 1 and used[0] in (1, 2):
        # Left or top everywhere: sums along rows or columns, channel by channel; the first row always adds from the left, the first column from the top.
        parts = residuals.astype("<u4").view(np.uint8).reshape(-1, width, 4).copy()
        parts[0, 0, 3] += np.uint8(255)
        first, then = (0, 1) if used[0] == 1 else (1, 0)
        edge = (slice(None), 0) if first == 0 else (0,)
        parts[edge] = np.cumsum(parts[edge], axis=0, dtype=np.uint8)
        return np.ascontiguousarray(np.cumsum(parts, axis=then, dtype=np.uint8)).view("<u4").ravel().astype(np.uint32)
    out, modes = [], modes.tolist()
    for at, r in enumerate(residuals.tolist()):
        out.append(_add(r, _neighbours(out, at, width, modes, block)))
    return np.array(out, np.uint32)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t.astype(np.int8).astype(np.int32) * c.astype(np.uint8).astype(np.int8) >> 5


def cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Add (sign 1: inverse) or take away (sign -1) what red and blue are told by green and red."""
    at = np.arange(len(pixels))
    e = elements[(at // width >> block) * -(-width >> block) + (at % width >> block)]
    red, green, blue = (pixels >> 16 & 255).astype(np.int32), (pixels >> 8 & 255).astype(np.int32), (pixels & 255).astype(np.int32)
    new_red = red + sign * _delta(e & 255, green) & 255
    true_red = new_red if sign > 0 else red
    new_blue = blue + sign * (_delta(e >> 8 & 255, green) + _delta(e >> 16 & 255, true_red)) & 255
    return pixels & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)


def add_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = (pixels >> 8 & 255).astype(np.int64)
    red, blue = (pixels >> 16 & 255) + sign * green & 255, (pixels & 255) + sign * green & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def packing(colours: int) -> int:
    """log2 of the number of palette indexes in a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    shift = packing(len(palette))
    index = (pixels >> 8 & 255).reshape(height, -1)
    if shift:
        each = 8 >> shift
        index = (index[:, :, None] >> (np.arange(1 << shift) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    return np.append(palette, np.zeros(256, np.uint32))[index.ravel()].astype(np.uint32)


# Containers and whole images


def payload(data: bytes) -> bytes:
    """The bitstream in a RIFF container; other chunks are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not WebP")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no lossless image")


def container(stream: bytes) -> bytes:
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def _head(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    return width, height


def _read_transforms(bits: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """The transforms in the order written, (kind, width, block, data), and the width of the pixels that follow."""
    found, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, *_ in found):
            raise ValueError("a transform that is given twice")
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            found.append((kind, now, block, read_image(bits, -(-now >> block), -(-height >> block))))
        elif kind == SUBTRACT:
            found.append((kind, now, 0, None))
        else:
            colours = bits.read(8) + 1
            steps = read_image(bits, colours, 1)
            palette = np.cumsum(steps.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()
            found.append((kind, now, 0, palette))
            now = -(-now >> packing(colours))
    return found, now


def _undo(pixels: np.ndarray, transforms: list[tuple], height: int) -> np.ndarray:
    for kind, across, block, data in reversed(transforms):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, across, data, block)
        elif kind == CROSS:
            pixels = cross_colour(pixels, across, data, block, 1)
        elif kind == SUBTRACT:
            pixels = add_green(pixels, 1)
        else:
            pixels = undo_palette(pixels, across, height, data)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, (height, width)."""
    bits = Bits(payload(data))
    width, height = _head(bits)
    transforms, now = _read_transforms(bits, width, height)
    return _undo(read_image(bits, now, height, main=True), transforms, height).reshape(height, width)


def _write_symbols(out: Writer, symbols: list[tuple], cache_bits: int) -> None:
    """Codes and symbols: ('p', pixel), ('c', cache place) or ('b', length, distance code)."""

    def split(value: int) -> tuple[int, int, int]:
        value -= 1
        if value < 4:
            return value, 0, 0
        extra = value.bit_length() - 2
        return 2 * extra + 2 + (value >> extra & 1), value & (1 << extra) - 1, extra

    counts = [Counter() for _ in range(5)]
    flat = []
    for kind, *v in symbols:
        if kind == "p":
            a, r, g, b = _parts(v[0])
            flat.append(((0, g), (1, r), (2, b), (3, a)))
        elif kind == "c":
            flat.append(((0, GREENS + v[0]),))
        else:
            (n, n_extra, n_bits), (d, d_extra, d_bits) = split(v[0]), split(v[1])
            flat.append(((0, LITERALS + n), ("x", n_extra, n_bits), (4, d), ("x", d_extra, d_bits)))
        for item in flat[-1]:
            if item[0] != "x":
                counts[item[0]][item[1]] += 1
    sizes = (GREENS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = []
    for c, size in zip(counts, sizes):
        lengths = code_lengths(c or Counter([0]), 15)
        write_code(out, lengths, size)
        codes.append(canonical(lengths))
    for items in flat:
        for item in items:
            out.put(*(item[1:] if item[0] == "x" else codes[item[0]][item[1]]))


def _write_image(out: Writer, pixels: np.ndarray, width: int, cache_bits: int = 0, references: bool = False, main: bool = False) -> None:
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    flat, symbols, cache, seen, at = pixels.ravel().tolist(), [], {}, {}, 0
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    while at < len(flat):
        run = 0
        if references and (start := seen.get(tuple(flat[at : at + 4]))) is not None:
            while at + run < len(flat) and run < 4096 and flat[start + run] == flat[at + run]:
                run += 1
        place = (HASH * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if run >= 4:
            symbols.append(("b", run, near.get(at - start, at - start + len(NEAR))))
        elif cache_bits and cache.get(place, 0) == flat[at]:
            symbols.append(("c", place))
        else:
            symbols.append(("p", flat[at]))
        for k in range(at, at + max(1, run) if run >= 4 else at + 1):
            if cache_bits:
                cache[(HASH * flat[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
            seen[tuple(flat[k : k + 4])] = k
        at += run if run >= 4 else 1
    _write_symbols(out, symbols, cache_bits)


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False, block: int = 2, modes=lambda n: np.arange(n) % 14) -> bytes:
    """A lossless WebP file of (height, width) pixels, with the transforms in the order given."""
    height, width = pixels.shape
    out, flat, now = Writer(), pixels.astype(np.uint32).ravel(), width
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        cells = -(-now >> block) * -(-height >> block)
        if kind == PREDICTOR:
            out.put(block - 2, 3)
            chosen = (np.asarray(modes(cells)).astype(np.uint32) << 8) | np.uint32(BLACK)
            _write_image(out, chosen, -(-now >> block))
            before = flat.tolist()
            flat = np.array([_sub(p, _neighbours(before, i, now, chosen.tolist(), block)) for i, p in enumerate(before)], np.uint32)
        elif kind == CROSS:
            out.put(block - 2, 3)
            elements = (np.arange(cells, dtype=np.uint32) * np.uint32(0x314159) & np.uint32(0xFFFFFF)) | np.uint32(BLACK)
            _write_image(out, elements, -(-now >> block))
            flat = cross_colour(flat, now, elements, block, -1)
        elif kind == SUBTRACT:
            flat = add_green(flat, -1)
        else:
            palette, index = np.unique(flat, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("too many colours for a palette")
            out.put(len(palette) - 1, 8)
            parts = palette.view(np.uint8).reshape(-1, 4)
            _write_image(out, np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).copy().view(np.uint32), len(palette))
            shift = packing(len(palette))
            rows = np.zeros((height, -(-now >> shift) << shift), np.uint32)
            rows[:, :now] = index.reshape(height, now)
            rows = (rows.reshape(height, -1, 1 << shift) << (np.arange(1 << shift, dtype=np.uint32) * (8 >> shift))).sum(axis=2)
            flat, now = (rows.astype(np.uint32) << 8 | np.uint32(BLACK)).ravel(), -(-now >> shift)
    out.put(0, 1)
    _write_image(out, flat, now, cache_bits, references, main=True)
    return container(out.bytes())


# Many grey images at once

#: Longest code in a batch's streams; short codes keep the lanes' look-up tables small.
LANE_BITS = 10
#: Below so many lanes, the rest is decoded one lane at a time.
FEW = 160
#: Images and samples that are coded at once when writing.
WRITTEN, WRITTEN_BYTES = 100, 1 << 20
#: Shortest and longest back-reference, and the farthest.
SHORTEST, LONGEST, FARTHEST = 6, 64, 1 << 20
#: Levels up to which an image gets a palette with several pixels in one, and the entropy below which it gets a predictor.
FEW_LEVELS, PREDICTED = 16, 0.97


def encode_batch(images: list[np.ndarray]) -> list[bytes]:
    """Grey images (height, width) of uint8 as files.

    Each gets the transform that suits it: a palette for few levels, else subtracted green, with a prediction from
    above where that lowers the entropy. Pixels are literals and back-references to the last equal stretch.
    """
    files, first, size = [], 0, 0
    for k, image in enumerate(images):
        if k > first and (k - first >= WRITTEN or size + image.size > WRITTEN_BYTES):
            files += _encode_batch(images[first:k])
            first, size = k, 0
        size += image.size
    return files + (_encode_batch(images[first:]) if images else [])


def _entropy(levels: np.ndarray) -> float:
    n = levels[levels > 0]
    return float(n @ (np.log2(n.sum()) - np.log2(n)))


def _prepared(image: np.ndarray, out: Writer) -> tuple[np.ndarray, int]:
    """Writes the head and transforms of an image; its green samples and the constant alpha."""
    height, width = image.shape
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 4)):
        out.put(value, n)
    counts = np.bincount(image.ravel(), minlength=256)
    used = np.flatnonzero(counts)
    if len(used) <= FEW_LEVELS:
        out.put(1 | PALETTE << 1, 3)
        out.put(len(used) - 1, 8)
        palette = np.repeat(used.astype(np.uint8)[:, None], 4, axis=1)
        palette[:, 3] = 255
        _write_image(out, np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).copy().view("<u4"), len(used))
        out.put(0, 1)
        shift = packing(len(used))
        index = np.zeros((height, -(-width >> shift) << shift), np.uint8)
        index[:, :width] = np.searchsorted(used, image)
        each = np.arange(1 << shift, dtype=np.uint8) * np.uint8(8 >> shift)
        return (index.reshape(height, -1, 1 << shift) << each).sum(axis=2, dtype=np.uint8).ravel(), 255
    out.put(1 | SUBTRACT << 1, 3)
    if height > 4:
        above = np.diff(image, axis=0)
        first = np.diff(image[0], prepend=np.uint8(0))
        residuals = np.concatenate((first[None], above)).astype(np.uint8)
        if _entropy(np.bincount(residuals.ravel(), minlength=256)) < PREDICTED * _entropy(counts):
            out.put(1 | PREDICTOR << 1, 3)
            out.put(7, 3)
            block = 9
            _write_image(out, np.full(-(-width >> block) * -(-height >> block), 2 << 8 | BLACK, np.uint32), -(-width >> block))
            out.put(0, 1)
            return residuals.ravel(), 0
    out.put(0, 1)
    return image.ravel(), 255


def _matches(x: np.ndarray, image: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every sample the length of the stretch that also begins at its last occurrence (0: none), and how far back that is."""
    n = len(x)
    length, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n <= SHORTEST:
        return length, back
    key = image[: n - SHORTEST + 1].astype(np.uint64) << np.uint64(48)
    for k in range(SHORTEST):
        key |= x[k : n - SHORTEST + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    # Hash and place in one number, so that a plain sort puts equal stretches side by side in their order.
    bits = np.uint64(n.bit_length())
    place = np.arange(n - SHORTEST + 1, dtype=np.uint64)
    order = np.sort((key * np.uint64(0x9E3779B97F4A7C15) >> bits << bits | place)[place + np.uint64(SHORTEST) <= ends[: n - SHORTEST + 1]])
    same = np.flatnonzero((order[1:] ^ order[:-1]) >> bits == 0)
    low = (np.uint64(1) << bits) - np.uint64(1)
    at, before = (order[1:][same] & low).astype(np.int64), (order[:-1][same] & low).astype(np.int64)
    true = (key[at] == key[before]) & (at - before <= FARTHEST)
    at, before = at[true], before[true]
    back[at], length[at] = at - before, SHORTEST
    for k in range(SHORTEST, LONGEST):
        go = at + k < ends[at]
        at, before = at[go], before[go]
        go = x[at + k] == x[before + k]
        at, before = at[go], before[go]
        if not len(at):
            break
        length[at] = k + 1
    return length, back


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, extra bits, their number) of lengths or distance codes, all at least 1."""
    w = values - 1
    n = np.maximum(0, np.frexp(np.maximum(w, 1).astype(float))[1] - 2)
    code = np.where(w < 4, w, 2 * n + 2 + (w >> n & 1))
    n = np.where(w < 4, 0, n)
    return code, w & ((1 << n) - 1), n


def _encode_batch(images: list[np.ndarray]) -> list[bytes]:
    heads = [Writer() for _ in images]
    prepared = [_prepared(image, out) for image, out in zip(images, heads)]
    x, sizes = np.concatenate([p for p, _ in prepared]), np.array([len(p) for p, _ in prepared])
    image = np.repeat(np.arange(len(images)), sizes)
    length, back = _matches(x, image, np.repeat(np.cumsum(sizes), sizes))
    # Greedy: take a stretch where there is one, and go on with the first one after its end.
    n = len(x)
    ahead = np.minimum.accumulate(np.where(np.append(length, 1) > 0, np.arange(n + 1), n)[::-1])[::-1]
    jump, taken, i = memoryview(ahead[np.arange(n) + length]), [], int(ahead[0])
    while i < n:
        taken.append(i)
        i = jump[i]
    refs = np.array(taken, np.int64)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, refs + 1, 1)
    np.add.at(covered, refs + length[refs], -1)
    at = np.flatnonzero(np.cumsum(covered)[:n] == 0)
    is_ref = np.zeros(n, bool)
    is_ref[refs] = True
    image, far = image[at], np.flatnonzero(is_ref[at])
    green = x[at].astype(np.int64)
    long_code, long_extra, long_bits = _prefixes(length[at[far]])
    back_code, back_extra, back_bits = _prefixes(back[at[far]] + len(NEAR))
    green[far] = LITERALS + long_code
    greens = np.bincount(image * GREENS + green, minlength=len(images) * GREENS).reshape(-1, GREENS)
    backs = np.bincount(image[far] * DISTANCES + back_code, minlength=len(images) * DISTANCES).reshape(-1, DISTANCES)
    codes, back_codes = np.zeros((len(images), GREENS), np.uint64), np.zeros((len(images), DISTANCES), np.uint64)  # code << 4 | its length
    for i, (out, (_, alpha)) in enumerate(zip(heads, prepared)):
        out.put(0, 2)  # neither a colour cache nor several groups of codes
        for table, counts, size in ((codes, greens[i], GREENS), (back_codes, backs[i], DISTANCES)):
            if size == DISTANCES:  # red, blue and alpha are the same everywhere
                for value in (0, 0, alpha):
                    write_code(out, {value: 1}, LITERALS)
            used = np.flatnonzero(counts)
            lengths = code_lengths(dict(zip(used.tolist(), counts[used].tolist())) or {0: 1}, LANE_BITS)
            write_code(out, lengths, size)
            found = canonical(lengths)
            table[i, list(found)] = [code << 4 | n for code, n in found.values()]
    # One item a literal, two a back-reference; extra bits follow their code in one item.
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(is_ref[at])[:-1]))
    value, n = np.zeros(len(at) + len(far), np.uint64), np.zeros(len(at) + len(far), np.int64)
    entry = codes[image, green]
    value[place], n[place] = entry >> np.uint64(4), (entry & np.uint64(15)).astype(np.int64)
    value[place[far]] |= long_extra.astype(np.uint64) << n[place[far]].astype(np.uint64)
    n[place[far]] += long_bits
    entry = back_codes[image[far], back_code]
    own = (entry & np.uint64(15)).astype(np.int64)
    value[place[far] + 1], n[place[far] + 1] = entry >> np.uint64(4) | back_extra.astype(np.uint64) << own.astype(np.uint64), own + back_bits
    first = place[np.searchsorted(image, np.arange(len(images)))]
    return _written(heads, value, n, first)


def _written(heads: list[Writer], code: np.ndarray, n: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Files of items (value, bits), each image's from ``first`` on, after its head."""
    for head in heads:
        head.settle()
    sizes = np.diff(np.append(first, len(code)))
    ends = np.cumsum(n)
    start = np.array([8 * len(h.done) + h.n for h in heads])
    total = start + np.add.reduceat(n, first)
    words = (total >> 6) + 2
    word_at = np.concatenate(([0], np.cumsum(words)[:-1]))
    bit = ends - n + np.repeat(64 * word_at + start - (ends - n)[first], sizes)
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    buffer = np.zeros(int(words.sum()) + 1, np.uint64)
    # Items do not overlap, so within a word their sum is their union.
    groups = np.flatnonzero(np.diff(word, prepend=-1))
    buffer[word[groups]] += np.add.reduceat(code << shift, groups)
    over = np.flatnonzero((bit & 63) + n > 64)
    buffer[word[over] + 1] += code[over] >> (np.uint64(64) - shift[over])
    files = []
    for i, head in enumerate(heads):
        raw = bytearray(buffer[word_at[i] : word_at[i] + words[i]].tobytes()[: (int(total[i]) + 7) // 8])
        if head.n:
            raw[len(head.done)] |= head.value & 255
        raw[: len(head.done)] = head.done
        files.append(container(bytes(raw)))
    return files


@dataclass
class Lane:
    """A stream whose pixels differ in green only, up to where its symbols begin."""

    number: int
    width: int
    height: int
    across: int  # pixels in a stored row
    transforms: list
    other: int  # alpha, red and blue of every stored pixel
    green: dict
    back: dict
    first: int
    data: bytes

    @property
    def size(self) -> int:
        return self.across * self.height


def _lane(number: int, data: bytes) -> Lane | None:
    """The lane of a file, or None for a stream that needs more than one."""
    bits = Bits(payload(data))
    width, height = _head(bits)
    transforms, across = _read_transforms(bits, width, height)
    if bits.read(2):
        return None
    green, red, blue, alpha, back = (read_code(bits, size) for size in (GREENS, LITERALS, LITERALS, LITERALS, DISTANCES))
    if max(len(red), len(blue), len(alpha)) > 1 or max(max(green.values()), max(back.values())) > LANE_BITS:
        return None
    return Lane(number, width, height, across, transforms, min(alpha) << 24 | min(red) << 16 | min(blue), green, back, bits.at, bits.data)


def decode_batch(files: list[bytes]) -> list[np.ndarray]:
    """The grey levels (height, width) of each file; any lossless file will do, streams of one group go lane by lane."""
    out: list = [None] * len(files)
    lanes = []
    for i, data in enumerate(files):
        if (lane := _lane(i, data)) is None:
            out[i] = (decode(data) >> 8 & 255).astype(np.uint8)
        else:
            lanes.append(lane)
    lanes.sort(key=lambda x: -x.size)
    for lane, green in zip(lanes, _decode_lanes(lanes)):
        if [k for k, *_ in lane.transforms] == [SUBTRACT]:
            out[lane.number] = green.reshape(lane.height, lane.width)  # green stays as it is
        else:
            pixels = _undo(green.astype(np.uint32) << 8 | np.uint32(lane.other), lane.transforms, lane.height)
            out[lane.number] = (pixels >> 8 & 255).astype(np.uint8).reshape(lane.height, lane.width)
    return out


#: What length and distance codes stand for: their least value and their extra bits.
_EXTRA = np.array([max(0, (c - 2) >> 1) for c in range(DISTANCES)])
_LEAST = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1 for c in range(DISTANCES)])


def _distances(code: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Distances in pixels from distance codes: neighbours first, then plain distances."""
    x, y = _NEAR_XY[np.minimum(code, len(NEAR)) - 1].T
    return np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, x + y * across))


_NEAR_XY = np.array(NEAR)


def _decode_lanes(lanes: list[Lane]) -> list[np.ndarray]:
    """Green samples of lanes sorted by falling size.

    Step k gives sample k of every lane that is that long: the next symbol's literal, or a sample copied from a
    back-reference's distance. Lanes in the middle of a copy read nothing.
    """
    if not lanes:
        return []
    greens, backs = np.zeros((len(lanes), 1 << LANE_BITS), np.uint16), np.zeros((len(lanes), 1 << LANE_BITS), np.uint16)
    position, at, streams, ends = np.zeros(len(lanes), np.int64), 0, [], []
    for k, lane in enumerate(lanes):
        greens[k], backs[k] = table_of(lane.green, LANE_BITS)[0], table_of(lane.back, LANE_BITS)[0]
        position[k] = 8 * at + lane.first
        streams.append(lane.data)
        at += len(lane.data)
        ends.append(at + 4)
    raw = np.frombuffer(b"".join([*streams, b"\0" * 8]), np.uint8)
    window = raw[4:].astype(np.int64)  # at each byte the next five, the first one lowest
    for k in (3, 2, 1, 0):
        window <<= 8
        window |= raw[k : len(raw) - 4 + k]
    green_of, back_of, sizes = greens.ravel(), backs.ravel(), np.array([x.size for x in lanes])
    base, across = np.arange(len(lanes), dtype=np.int64) << LANE_BITS, np.array([x.across for x in lanes])
    steps = int(sizes[FEW - 1]) if len(lanes) >= FEW else 0  # from here on fewer than FEW lanes go on
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # lanes with more samples than the step's number
    offset = np.concatenate(([0], np.cumsum(alive)))
    got = np.empty(int(offset[-1]), np.uint8)  # step after step, each the samples of the lanes that are alive
    mask = (1 << LANE_BITS) - 1
    left, far = np.zeros(len(lanes), np.int64), np.ones(len(lanes), np.int64)  # samples still to copy, and from how far back
    for step, n in enumerate(alive.tolist()):
        row = got[offset[step] : offset[step] + n]
        reading = np.flatnonzero(left[:n] == 0)
        p = position[reading]
        entry = green_of[(window[p >> 3] >> (p & 7) & mask) + base[reading]]
        p += entry & 15
        symbol = entry >> 4
        row[reading] = symbol
        new = np.flatnonzero(symbol >= LITERALS)
        if len(new):
            lane, q, code = reading[new], p[new], symbol[new].astype(np.int64) - LITERALS
            extra = _EXTRA[code]
            left[lane] = _LEAST[code] + (window[q >> 3] >> (q & 7) & ((1 << extra) - 1))
            q += extra
            entry = back_of[(window[q >> 3] >> (q & 7) & mask) + base[lane]]
            q += entry & 15
            code = (entry >> 4).astype(np.int64)
            extra = _EXTRA[code]
            far[lane] = _distances(_LEAST[code] + (window[q >> 3] >> (q & 7) & ((1 << extra) - 1)), across[lane])
            p[new] = q + extra
        position[reading] = p
        copying = np.flatnonzero(left[:n])
        if len(copying):
            source = step - far[copying]
            if source.min() < 0:
                raise ValueError("a back-reference outside the image")
            row[copying] = got[offset[source] + copying]
            left[copying] -= 1
    out = []
    for k, size in enumerate(sizes.tolist()):
        done = min(size, steps)
        samples = bytearray(got[offset[:done] + k].tobytes())
        if done < size:
            _finish(samples, window[: ends[k]], int(position[k]), greens[k].tolist(), backs[k].tolist(), size, int(left[k]), int(far[k]), int(across[k]))
        out.append(np.frombuffer(samples, np.uint8))
    return out


def _finish(out: bytearray, window: np.ndarray, at: int, green: list, back: list, size: int, left: int, far: int, across: int) -> None:
    """The rest of one lane, appended to ``out``."""
    mask, least, extras = (1 << LANE_BITS) - 1, _LEAST.tolist(), _EXTRA.tolist()
    first, at = at >> 3, at & 7
    near = window[first:].tolist()
    while True:
        if left:
            if far > len(out) or len(out) + left > size:
                raise ValueError("a back-reference outside the image")
            start = len(out) - far
            if far >= left:
                out += out[start : start + left]
            else:
                out += (out[start:] * (left // far + 1))[:left]
        if len(out) >= size:
            return
        entry = green[near[at >> 3] >> (at & 7) & mask]
        at += entry & 15
        symbol = entry >> 4
        if symbol < LITERALS:
            out.append(symbol)
            left = 0
            continue
        n = extras[symbol - LITERALS]
        left = least[symbol - LITERALS] + (near[at >> 3] >> (at & 7) & ((1 << n) - 1))
        at += n
        entry = back[near[at >> 3] >> (at & 7) & mask]
        at += entry & 15
        n = extras[entry >> 4]
        far = least[entry >> 4] + (near[at >> 3] >> (at & 7) & ((1 << n) - 1))
        at += n
        if far > len(NEAR):
            far -= len(NEAR)
        else:
            x, y = NEAR[far - 1]
            far = max(1, x + y * across)
