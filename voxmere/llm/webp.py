"""Lossless WebP (VP8L) as a column codec: bytes to images of 8-bit RGBA samples and back.

The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. The encoder writes prefix codes fitted to each image, back-references to
runs of equal pixels and to sequences seen before, and a colour cache where it saves bits; an image of few colours
gets a palette, a smooth one (a picture rather than a text) those of the predictor, cross-colour and subtract-green
transforms that lower its entropy.

An image with one group of prefix codes, as the encoder writes them, is decoded without a step per bit: the code at
every bit position is looked up at once, pixels are found by following positions, and references to pixels and to
the cache are resolved for all pixels together.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import in_batches, table

#: Fixed values of the format: in which order the lengths of the code for code lengths come.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Near pixels by the distance codes 1 to 120: by distance, then from the column above outwards, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
BLOCK_BYTES, ROW_PIXELS, MOST_ROWS, LONGEST_CODE = 576, 144, 16384, 12
BLACK = (0, 0, 0, 255)


# --- bits ---------------------------------------------------------------------------------------------------


class Bits:
    """Reads bits, the lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int = 32) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + (n + 14 >> 3)], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.at += n
        return out


class Writer:
    """Collects (value, number of bits), the lowest bit first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


@functools.cache
def reversed_bits(n: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


# --- prefix codes -------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code, with counts evened out until none is longer than `longest`."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weight, kind="stable")
        leaves = weight[order].tolist()
        n = len(leaves)
        nodes: list[int] = []
        parent = [0] * (2 * n - 1)
        i = j = 0
        for k in range(n, 2 * n - 1):  # leaves and inner nodes both come in rising order
            total = 0
            for _ in range(2):
                if i < n and (j >= len(nodes) or leaves[i] <= nodes[j]):
                    total += leaves[i]
                    parent[i] = k
                    i += 1
                else:
                    total += nodes[j]
                    parent[n + j] = k
                    j += 1
            nodes.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= longest:
            out[used[order]] = depth[:n]
            return out
        weight = (weight + 1) // 2


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, its first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    most = int(lengths.max())
    size = 1 << (most - lengths[order])
    first = np.cumsum(size) - size
    out[order] = reversed_bits(most)[first]
    return out


class Code:
    """Lookup tables of a prefix code: symbol and length by the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.int64)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        self.bits = int(lengths.max())
        size = 1 << (self.bits - lengths[order])
        if size.sum() != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        turn = reversed_bits(self.bits)
        self.symbol, self.length = np.repeat(order, size)[turn], np.repeat(lengths[order], size)[turn]

    def read(self, bits: Bits) -> int:
        at = bits.peek(self.bits) if self.bits else 0
        bits.at += int(self.length[at])
        return int(self.symbol[at])


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(own)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbols, sizes = code.symbol.tolist(), code.length.tolist()
    mask = (1 << code.bits) - 1
    at, before = 0, 8
    while at < alphabet and most > 0:
        most -= 1
        window = bits.peek(16)
        s = symbols[window & mask]
        n = sizes[window & mask]
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        elif s == 16:
            m = 3 + ((window >> n) & 3)
            lengths[at : at + m] = before
            at, n = at + m, n + 2
        elif s == 17:
            at, n = at + 3 + ((window >> n) & 7), n + 3
        else:
            at, n = at + 11 + ((window >> n) & 127), n + 7
        bits.at += n
    return Code(lengths)


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[Code]:
    """The codes of a group; one that is written with the same bits as the one before it is the same code."""
    out: list[Code] = []
    written, size = -1, 0
    for k, alphabet in enumerate(sizes):
        if k and alphabet == sizes[k - 1] and bits.peek(size) == written:
            out.append(out[-1])
            bits.at += size
            continue
        begin = bits.at
        out.append(read_code(bits, alphabet))
        size = bits.at - begin
        written = Bits(bits.data, begin).peek(size)
    return out


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1), out.put(len(used) - 1, 1), out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    at = 0
    for s in used:
        gap = s - at
        while gap >= 3:
            m = min(gap, 138)
            tokens.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
            gap -= m
        tokens += [(0, 0, 0)] * gap + [(int(lengths[s]), 0, 0)]
        at = s + 1
    gap = len(lengths) - at
    while gap >= 3:
        m = min(gap, 138)
        tokens.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
        gap -= m
    tokens += [(0, 0, 0)] * gap
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes, sizes = codes_of(own).tolist(), own.tolist()
    if sum(n > 0 for n in sizes) == 1:
        sizes_read = [0] * 19
    else:
        sizes_read = sizes
    given = max(k for k in range(19) if sizes[LENGTH_ORDER[k]]) + 1
    out.put(0, 1), out.put(max(0, given - 4), 4)
    for k in range(max(4, given)):
        out.put(sizes[LENGTH_ORDER[k]], 3)
    out.put(0, 1)
    for s, extra, n in tokens:
        out.put(codes[s], sizes_read[s])
        out.put(extra, n)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    n = high - 1
    return 2 * high + (((value - 1) >> n) & 1), (value - 1) & ((1 << n) - 1), n


def value_of(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


# --- entropy-coded images -----------------------------------------------------------------------------------


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


_EIGHT = np.arange(8)[None, :]
_COUNTING = [np.arange(1 << 16)]


def _counting(n: int) -> np.ndarray:
    if n > len(_COUNTING[0]):
        _COUNTING[0] = np.arange(2 * n)
    return _COUNTING[0][:n]


def _cache_keys(value: np.ndarray, bits: int) -> np.ndarray:
    """Places in a colour cache of 2**bits pixels of RGBA values as little-endian numbers."""
    argb = (value & 0xFF00FF00) | ((value & 0xFF) << 16) | ((value >> 16) & 0xFF)
    return ((argb.astype(np.uint64) * np.uint64(0x1E35A7BD)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - bits)


def _before(key: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same key, or -1."""
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")  # numpy sorts short numbers by radix
    out = np.full(len(key), -1)
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _resolved(value: np.ndarray, key: np.ndarray, copies: list[tuple[int, int, int]], cache_bits: int) -> np.ndarray:
    """The pixels' values: known ones, copies (first, number, distance), and those at a key of the cache (key -1: not from there)."""
    n = len(value)
    source = np.arange(n)  # the pixel that a copied one comes from in the end, read from the stream itself
    copied = np.zeros(n, bool)
    for first, count, far in copies:
        if far > first:
            raise ValueError("reference before the first pixel")
        source[first : first + count] = source[first - far : first - far + count] if far >= count else np.resize(source[first - far : first], count)
        copied[first : first + count] = True
    from_cache = key >= 0
    if from_cache.any():
        keys = np.where(from_cache, key, _cache_keys(value, cache_bits))[source]
        order = np.argsort(keys.astype(np.uint16), kind="stable")
        # the last pixel before it with its key that is not itself from the cache; n, the cache as it is at first, where there is none
        place = np.arange(n)
        filled = np.maximum.accumulate(np.where(from_cache[order] & ~copied[order], -1, place))
        first_of_key = np.maximum.accumulate(np.where(np.diff(keys[order], prepend=-1) != 0, place, 0))
        last = np.empty(n, np.int64)
        last[order] = np.where(filled >= first_of_key, order[np.maximum(filled, 0)], n)
        value, source = np.append(value, np.uint32(0)), np.append(source, n)
        unknown = np.append(from_cache, False)
        while (open_ := unknown[source]).any():  # through copies of pixels from the cache
            source = np.where(open_, source[np.append(last, n)[source]], source)
    return value[source[:n]]


def _read_lengths_at_once(bits: Bits, codes: list[Code], width: int, pixels: int, cache_bits: int) -> np.ndarray:
    """Pixels (RGBA rows) where one group of codes holds throughout."""
    green, red, blue, alpha, distance = codes
    origin = bits.at >> 3
    raw = np.frombuffer(bits.data[origin:] + bytes(16), np.uint8).astype(np.int64)
    word = raw[:-2] | (raw[1:-1] << 8) | (raw[2:] << 16)
    window = (word[:, None] >> _EIGHT).ravel()
    last = len(window) - 64
    at_green = window & ((1 << green.bits) - 1)
    size = [green.length[at_green]]
    for k, c in enumerate(codes[1:4]):
        size.append(size[-1] if k and c is codes[k] else c.length[window & ((1 << c.bits) - 1)])
    to_red = size[0][:last] + _counting(last)
    to_blue = to_red + size[1][to_red]
    to_alpha = to_blue + size[2][to_blue]
    after = to_alpha + size[3][to_alpha]
    symbol = green.symbol[at_green[:last]]
    after[symbol >= LITERALS] = -1
    if cache_bits:
        cached = symbol >= LITERALS + LENGTHS
        after[cached] = to_red[cached]
    step = memoryview(after)  # few of its places are visited
    base = origin * 8
    here, done = bits.at - base, 0
    literal: list[int] = []
    copies: list[tuple[int, int, int]] = []
    while done < pixels:
        then = step[here]
        if then >= 0:
            literal.append(here)
            here = then
            done += 1
            continue
        sub = Bits(bits.data, base + int(to_red[here]))
        n = value_of(int(symbol[here]) - LITERALS, sub)
        far = distance_of(value_of(distance.read(sub), sub), width)
        n = min(n, pixels - done)
        copies.append((done, n, far))
        here = sub.at - base
        done += n
    bits.at = base + here
    value, key = np.zeros(pixels, np.uint32), np.full(pixels, -1)
    if literal:
        q = np.array(literal)
        values = np.empty((len(q), 4), np.uint8)
        values[:, 1] = symbol[q]
        for channel, code, where in ((0, red, to_red[q]), (2, blue, to_blue[q]), (3, alpha, to_alpha[q])):
            values[:, channel] = code.symbol[window[where] & ((1 << code.bits) - 1)]
        there = np.ones(pixels, bool)
        for first, n, _ in copies:
            there[first : first + n] = False
        value[there] = values.view("<u4").ravel()
        if cache_bits:
            key[there] = np.where(symbol[q] >= LITERALS + LENGTHS, symbol[q] - LITERALS - LENGTHS, -1)
    if copies or cache_bits:
        value = _resolved(value, key, copies, cache_bits)
    return value.astype("<u4").view(np.uint8).reshape(pixels, 4)


def _read_one_by_one(bits: Bits, groups: list[list[Code]], group_of, width: int, pixels: int, cache_bits: int) -> np.ndarray:
    out = np.zeros((pixels, 4), np.uint8)
    cache = np.zeros((1 << cache_bits, 4), np.uint8) if cache_bits else None

    def remember(a: int, b: int) -> None:
        if cache is not None:
            for p in out[a:b]:
                argb = int(p[3]) << 24 | int(p[0]) << 16 | int(p[1]) << 8 | int(p[2])
                cache[((0x1E35A7BD * argb) & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    i = 0
    while i < pixels:
        green, red, blue, alpha, distance = groups[group_of(i)]
        s = green.read(bits)
        if s < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[i] = (r, s, b, a)
            n = 1
        elif s < LITERALS + LENGTHS:
            n = min(value_of(s - LITERALS, bits), pixels - i)
            far = distance_of(value_of(distance.read(bits), bits), width)
            if far > i:
                raise ValueError("reference before the first pixel")
            for k in range(i, i + n):
                out[k] = out[k - far]
        else:
            out[i] = cache[s - LITERALS - LENGTHS]
            n = 1
        remember(i, i + n)
        i += n
    return out


def read_image(bits: Bits, width: int, height: int, outer: bool = False) -> np.ndarray:
    """height x width x RGBA of an entropy-coded image; only the outermost one may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tiles, shift = 1, None, 0
    if outer and bits.read(1):
        shift = bits.read(3) + 2
        tiles = read_image(bits, -(-width >> shift), -(-height >> shift)).astype(np.int64)
        tiles = tiles[:, :, 0] << 8 | tiles[:, :, 1]
        groups = int(tiles.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [_read_codes(bits, sizes) for _ in range(groups)]
    if groups == 1:
        flat = _read_lengths_at_once(bits, codes[0], width, width * height, cache_bits)
    else:
        flat = _read_one_by_one(bits, codes, (lambda i: int(tiles[(i // width) >> shift, (i % width) >> shift])) if tiles is not None else (lambda i: 0), width, width * height, cache_bits)
    return flat.reshape(height, width, 4)


# --- transforms ---------------------------------------------------------------------------------------------


def _half(a, b):
    return (a + b) >> 1


def _closer(left, top, corner):
    """left or top, whichever is nearer to left + top - corner over all channels."""
    guess = left + top - corner
    return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top


_PREDICT = (
    lambda l, t, tr, tl: np.array(BLACK),
    lambda l, t, tr, tl: l,
    lambda l, t, tr, tl: t,
    lambda l, t, tr, tl: tr,
    lambda l, t, tr, tl: tl,
    lambda l, t, tr, tl: _half(_half(l, tr), t),
    lambda l, t, tr, tl: _half(l, tl),
    lambda l, t, tr, tl: _half(l, t),
    lambda l, t, tr, tl: _half(tl, t),
    lambda l, t, tr, tl: _half(t, tr),
    lambda l, t, tr, tl: _half(_half(l, tl), _half(t, tr)),
    lambda l, t, tr, tl: _closer(l, t, tl),
    lambda l, t, tr, tl: np.clip(l + t - tl, 0, 255),
    lambda l, t, tr, tl: np.clip(_half(l, t) + np.trunc((_half(l, t) - tl) / 2).astype(np.int64), 0, 255),
)


def prediction(image: np.ndarray, y: int, x: int, mode: int) -> np.ndarray:
    """What a pixel is predicted as from those before it; the pixel beyond the right edge is the row's first."""
    if y == 0:
        return np.array(BLACK) if x == 0 else image[0, x - 1]
    if x == 0:
        return image[y - 1, 0]
    corner = image[y - 1, x + 1] if x + 1 < image.shape[1] else image[y, 0]
    return _PREDICT[mode if mode < 14 else 0](image[y, x - 1], image[y - 1, x], corner, image[y - 1, x - 1])


#: Modes that need nothing of the pixel's own row, by what they need of the row above: itself, its right or left neighbour, or a mean of these.
_FROM_ABOVE = {2: lambda t, tr, tl: t, 3: lambda t, tr, tl: tr, 4: lambda t, tr, tl: tl, 8: lambda t, tr, tl: _half(tl, t), 9: lambda t, tr, tl: _half(t, tr)}


def undo_predictor(residue: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """A row's stretches of one mode at once where the mode allows it (the pixel above and its neighbours, or sums from the left), pixel by pixel in the others."""
    out = residue.astype(np.int64)
    height, width = out.shape[:2]
    out[0, 0] = (out[0, 0] + BLACK) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        row = np.repeat(modes[y >> shift, :, 1], 1 << shift)[:width]
        ends = [*(np.flatnonzero(np.diff(row[1:])) + 2).tolist(), width]
        begin = 1
        for end in ends:
            if begin >= end:
                continue
            mode = int(row[begin]) if row[begin] < 14 else 0
            here = slice(begin, end)
            if mode == 0:
                out[y, here] = (out[y, here] + BLACK) & 255
            elif mode == 1:
                out[y, here] = (out[y, begin - 1] + np.cumsum(out[y, here], axis=0)) & 255
            elif mode in _FROM_ABOVE:
                right = np.concatenate([out[y - 1, begin + 1 : min(end + 1, width)], out[y, :1]])[: end - begin]  # beyond the right edge: the row's first
                out[y, here] = (out[y, here] + _FROM_ABOVE[mode](out[y - 1, here], right, out[y - 1, begin - 1 : end - 1])) & 255
            else:
                for x in range(begin, end):
                    out[y, x] = (out[y, x] + prediction(out, y, x, mode)) & 255
            begin = end
    return out.astype(np.uint8)


def predictor_residue(image: np.ndarray, mode: int) -> np.ndarray:
    """What is left of each pixel after mode 1 (left) or 2 (above)."""
    a = image.astype(np.int64)
    out = a.copy()
    out[0, 1:] -= a[0, :-1]
    out[0, 0] -= BLACK
    out[1:, 0] -= a[:-1, 0]
    out[1:, 1:] -= a[1:, :-1] if mode == 1 else a[:-1, 1:]
    return (out & 255).astype(np.uint8)


def entropy(image: np.ndarray) -> float:
    """Bits of the image's samples by the frequencies of each channel's values."""
    counts = np.stack([np.bincount(image[..., k].ravel(), minlength=256) for k in range(4)]).astype(float)
    return float(-(counts * np.log2(np.maximum(counts, 1) / counts.sum(axis=1, keepdims=True))).sum())


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int8).astype(np.int64)


def cross_colour(image: np.ndarray, elements: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (-1) what red and blue share with green and blue with red; an element has red to blue, green to blue and green to red as its red, green and blue."""
    rows, columns = np.arange(image.shape[0]) >> shift, np.arange(image.shape[1]) >> shift
    e = _signed(elements[rows][:, columns])
    out = image.astype(np.int64)
    green = _signed(image[:, :, 1])
    before = _signed(image[:, :, 0])
    out[:, :, 0] = (out[:, :, 0] + sign * (e[:, :, 2] * green >> 5)) & 255
    red = _signed(out[:, :, 0]) if sign > 0 else before
    out[:, :, 2] = (out[:, :, 2] + sign * (e[:, :, 1] * green >> 5) + sign * (e[:, :, 0] * red >> 5)) & 255
    return out.astype(np.uint8)


def shift_of_palette(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(indices: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    shift = shift_of_palette(len(palette))
    n = 8 >> shift
    green = indices[:, :, 1].astype(np.int64)
    if shift:
        green = (green[:, :, None] >> (n * np.arange(1 << shift))) & ((1 << n) - 1)
    all_colours = np.zeros((256, 4), np.uint8)
    all_colours[: len(palette)] = palette
    return all_colours[green.reshape(len(indices), -1)[:, :width]]


# --- files --------------------------------------------------------------------------------------------------


def decode(data: bytes) -> np.ndarray:
    """height x width x RGBA samples of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data, 21 * 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            shift = bits.read(3) + 2
            tiles = read_image(bits, -(-inner >> shift), -(-height >> shift))
            undo.append((lambda im, t=tiles, s=shift: undo_predictor(im, t, s)) if kind == 0 else (lambda im, t=tiles, s=shift: cross_colour(im, t, s, 1)))
        elif kind == 2:
            undo.append(lambda im: np.stack([im[:, :, 0] + im[:, :, 1], im[:, :, 1], im[:, :, 2] + im[:, :, 1], im[:, :, 3]], axis=2))
        else:
            colours = bits.read(8) + 1
            palette = np.cumsum(read_image(bits, colours, 1)[0], axis=0, dtype=np.int64).astype(np.uint8)
            undo.append(lambda im, p=palette, w=inner: undo_palette(im, p, w))
            inner = -(-inner >> shift_of_palette(colours))
    image = read_image(bits, inner, height, outer=True)
    for step in reversed(undo):
        image = step(image)
    return image


#: Images whose neighbouring samples differ by less than this on average are smooth.
SMOOTH = 12
#: Fewest pixels of a back-reference and how far back it may go.
LEAST_COPY, FURTHEST = 6, 100_000
#: Bits that a colour cache must save by estimate; its codes take some thousands to write.
CACHE_GAIN = 4000


def _copies(value: np.ndarray, same: np.ndarray) -> list[tuple[int, int, int]]:
    """(first pixel, number, distance): runs of equal pixels, and sequences that equal an earlier one."""
    n = len(value)
    out: list[tuple[int, int, int]] = []
    if same.any():
        change = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        out = [(a, b - a, 1) for a, b in zip(change[::2].tolist(), change[1::2].tolist()) if b - a >= 3]
    if n > 2 * LEAST_COPY:
        with np.errstate(over="ignore"):
            h = value.astype(np.uint64)
            whole = np.zeros(n - LEAST_COPY + 1, np.uint64)
            for k in range(LEAST_COPY):
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(whole)]
            last = _before((whole >> np.uint64(48)).astype(np.int64))
        maybe = np.flatnonzero(last >= 0)
        maybe = maybe[(whole[maybe] == whole[last[maybe]]) & (maybe - last[maybe] <= FURTHEST)]
        runs = iter(out)
        run = next(runs, None)
        found, done = [], 0
        for i, j in zip(maybe.tolist(), last[maybe].tolist()):
            if i < done:
                continue
            while run is not None and run[0] + run[1] <= i:
                run = next(runs, None)
            stop = n if run is None else max(i, run[0])
            most = min(4096, stop - i)
            if most < LEAST_COPY:
                continue
            differ = np.flatnonzero(value[i : i + most] != value[j : j + most])
            m = int(differ[0]) if len(differ) else most
            if m >= LEAST_COPY:
                found.append((i, m, i - j))
                done = i + m
        out = sorted(out + found)
    return [(a + k, min(4096, m - k), far) for a, m, far in out for k in range(0, m, 4096)]


def _write_pixels(out: Writer, flat: np.ndarray, outer: bool) -> bytes:
    """Ends the stream: prefix codes, then literals, copies and, where it saves bits, keys of the colour cache."""
    value = np.ascontiguousarray(flat).view("<u4").ravel()
    n = len(value)
    same = np.zeros(n, bool)
    same[1:] = value[1:] == value[:-1]
    keep, copies = np.ones(n, bool), _copies(value, same)
    for i, m, _ in copies:
        keep[i : i + m] = False
    at = [i for i, _, _ in copies]
    cache_bits, hit = 0, np.zeros(n, bool)
    if n * 16 > CACHE_GAIN:
        width = 8 if n < 4096 else 10
        keys = _cache_keys(value, width)
        last = _before(keys)
        hit = keep & (last >= 0) & (value == value[last])
        share = np.bincount(flat.ravel(), minlength=256) / (4 * n)
        if int(hit.sum()) * (-4 * float(share @ np.log2(np.maximum(share, 1e-12))) - width - 1) > CACHE_GAIN:
            cache_bits = width
        else:
            hit[:] = False
    cached = hit[keep]
    literal = flat[keep] if copies else flat
    plain = literal[~cached] if cache_bits else literal
    symbol = literal[:, 1].astype(np.int64)
    if cache_bits:
        symbol[cached] = LITERALS + LENGTHS + keys[keep][cached]
    lengths_coded = [prefix_of(m) for _, m, _ in copies]
    near = NEAR.index((1, 0)) + 1
    distances_coded = [prefix_of(near if far == 1 else far + 120) for _, _, far in copies]
    green = np.bincount(symbol, minlength=LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0))
    rest = np.bincount(plain.ravel(), minlength=256) - np.bincount(plain[:, 1], minlength=256)
    for s, _, _ in lengths_coded:
        green[LITERALS + s] += 1
    size_g, size_x = code_lengths(green), code_lengths(rest)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if outer:
        out.put(0, 1)
    write_code(out, size_g)
    one = Writer()
    write_code(one, size_x)
    for _ in range(3):
        out.put(one.value, one.n)
    distance = np.bincount([s for s, _, _ in distances_coded] or [prefix_of(near)[0]], minlength=DISTANCES)
    size_d = code_lengths(distance)
    write_code(out, size_d)
    code_g, code_x, code_d = codes_of(size_g), codes_of(size_x), codes_of(size_d)
    bits_g, bits_x, bits_d = (s if np.count_nonzero(s) > 1 else s * 0 for s in (size_g, size_x, size_d))
    m = len(literal)
    values, sizes = np.zeros((m + len(copies), 4), np.int64), np.zeros((m + len(copies), 4), np.int64)
    values[:m, 0], sizes[:m, 0] = code_g[symbol], bits_g[symbol]
    for k, channel in ((1, 0), (2, 2), (3, 3)):
        values[:m, k], sizes[:m, k] = code_x[literal[:, channel]], bits_x[literal[:, channel]]
    if cache_bits:
        values[:m, 1:][cached], sizes[:m, 1:][cached] = 0, 0
    for k, ((s, extra, count), (d, more, places)) in enumerate(zip(lengths_coded, distances_coded)):
        values[m + k], sizes[m + k] = (code_g[LITERALS + s], extra, code_d[d], more), (bits_g[LITERALS + s], count, bits_d[d], places)
    if copies:
        order = np.argsort(np.concatenate([np.flatnonzero(keep), np.array(at, np.int64)]), kind="stable")
        values, sizes = values[order], sizes[order]
    values, sizes = values.ravel(), sizes.ravel()
    offset = out.n + np.cumsum(sizes) - sizes
    total = (out.n + int(sizes.sum()) + 7) // 8 + 3
    shifted, byte = values << (offset & 7), offset >> 3
    body = sum(np.bincount(byte + k, weights=(shifted >> (8 * k)) & 255, minlength=total) for k in range(3))
    head = np.frombuffer(out.value.to_bytes(total, "little"), np.uint8)
    return (body.astype(np.int64) + head).astype(np.uint8)[:-3].tobytes()


def _smoothed(out: Writer, image: np.ndarray) -> np.ndarray:
    """Writes those of the subtract-green, predictor and cross-colour transforms that lower the entropy; what is left of the image."""
    height, width = image.shape[:2]
    shift = 9
    tiles = np.zeros((-(-height >> shift), -(-width >> shift), 4), np.uint8)
    tiles[..., 3] = 255
    best = entropy(image)
    green = image.copy()
    green[..., 0] -= image[..., 1]
    green[..., 2] -= image[..., 1]
    if (now := entropy(green)) < 0.98 * best:
        out.put(1, 1), out.put(2, 2)
        image, best = green, now
    mode, residue, now = min(((k, r, entropy(r)) for k in (1, 2) for r in [predictor_residue(image, k)]), key=lambda x: x[2])
    if now < 0.98 * best:
        out.put(1, 1), out.put(0, 2), out.put(shift - 2, 3)
        modes = tiles.copy()
        modes[..., 1] = mode
        _write_plain(out, modes)
        image, best = residue, now
    g, r, b = (_signed(image[..., k]).ravel() for k in (1, 0, 2))
    slope = lambda x, y: int(np.clip(round(32 * float(x @ y) / max(1.0, float(x @ x))), -128, 127))
    element = tiles.copy()
    element[..., 2] = slope(g, r) & 255
    element[..., 1] = slope(g, b) & 255
    crossed = cross_colour(image, element, shift, -1)
    if entropy(crossed) < 0.98 * best:
        out.put(1, 1), out.put(1, 2), out.put(shift - 2, 3)
        _write_plain(out, element)
        image = crossed
    return image


def _write_plain(out: Writer, image: np.ndarray) -> None:
    """An inner image (such as a palette) as literals."""
    inner = Writer()
    data = _write_pixels(inner, image.reshape(-1, 4), outer=False)
    n = _bit_length(data, image)
    out.put(int.from_bytes(data, "little"), n)


def _bit_length(data: bytes, image: np.ndarray) -> int:
    bits = Bits(data)
    read_image(bits, image.shape[1], image.shape[0])
    return bits.at


def encode(image: np.ndarray) -> bytes:
    """A lossless WebP file of height x width x RGBA samples."""
    height, width = image.shape[:2]
    out = Writer()
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(1, 1), out.put(0, 3)
    flat = image.reshape(-1, 4)
    value = np.ascontiguousarray(flat).view("<u4").ravel()
    colours = np.unique(value[:64])
    colours = np.unique(value) if len(colours) <= 16 else colours
    if len(colours) <= 16:
        palette = colours.astype("<u4").view(np.uint8).reshape(-1, 4)
        index = np.searchsorted(colours, value).reshape(height, width)
        shift = shift_of_palette(len(palette))
        padded = np.zeros((height, -(-width >> shift) << shift), np.int64)
        padded[:, :width] = index
        n = 8 >> shift
        bundled = (padded.reshape(height, -1, 1 << shift) << (n * np.arange(1 << shift))).sum(axis=2)
        out.put(1, 1), out.put(3, 2), out.put(len(palette) - 1, 8)
        _write_plain(out, np.diff(palette.astype(np.int64), axis=0, prepend=0).astype(np.uint8)[None])
        flat = np.zeros((bundled.size, 4), np.uint8)
        flat[:, 1], flat[:, 3] = bundled.ravel(), 255
    elif width > 1 and np.abs(_signed(image[:, 1:] - image[:, :-1])).mean() < SMOOTH:
        flat = _smoothed(out, image).reshape(-1, 4)
    out.put(0, 1)
    data = _write_pixels(out, flat, outer=True)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(data) % 2) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


# --- columns ------------------------------------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % BLOCK_BYTES or (0 if text else BLOCK_BYTES))


def store(payload: bytes) -> bytes:
    """Images of ROW_PIXELS pixels a row, one after the other; more than one only beyond MOST_ROWS rows."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 4)
    return b"".join(encode(samples[a : a + MOST_ROWS]) for a in range(0, len(samples), MOST_ROWS))


def load(media: bytes) -> np.ndarray:
    images, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        images.append(decode(media[at : at + size]))
        at += size
    return np.concatenate(images)


def feature_of(samples: np.ndarray) -> str:
    """Rows, columns, the mean of each channel and the shares (in thousandths) of eight levels of brightness."""
    levels = np.bincount(samples.ravel() >> 5, minlength=8) * 1000 // samples.size
    means = samples.reshape(-1, 4).mean(axis=0)
    return f"{samples.shape[0]}x{samples.shape[1]}|" + ",".join(f"{m:.3f}" for m in means) + "|" + ",".join(map(str, levels))


def with_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with each whole text (null: empty) stored as lossless WebP."""

    @F.arrow_udf("binary")
    def write(column: pa.Array) -> pa.Array:
        return pa.array([store(payload_of(x or b"")) for x in column.cast(pa.binary()).to_pylist()], pa.binary())

    return df.withColumn(out, write(F.col(text)))


_READ = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"


def read_media(df: DataFrame, media: str = "media", out: str = "read") -> DataFrame:
    """df with what the stored images hold: size and digests of the samples and of the stored form, and a feature. Null gives null."""

    @F.arrow_udf(_READ)
    def read(column: pa.Array) -> pa.Array:
        rows = []
        for stored in column.to_pylist():
            if stored is None:
                rows.append(None)
                continue
            samples = load(stored)
            payload = samples.tobytes()
            rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature_of(samples)})
        kinds = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        return pa.array(rows, kinds)

    return in_batches(df).withColumn(out, read(F.col(media)))


def pixels(df: DataFrame, media: str = "media", out: str = "samples") -> DataFrame:
    """df with the decoded samples as a byte column and the image's height and width."""

    @F.arrow_udf("struct<height:int,width:int,data:binary>")
    def read(column: pa.Array) -> pa.Array:
        rows = [None if x is None else load(x) for x in column.to_pylist()]
        return pa.array([None if s is None else {"height": s.shape[0], "width": s.shape[1], "data": s.tobytes()} for s in rows], pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))

    return in_batches(df).withColumn(out, read(F.col(media)))


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return read_media(with_media(docs)).select("doc_id", "n_bytes", "read.*")
