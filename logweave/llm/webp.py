"""Lossless WebP (VP8L): a full decoder to pixel arrays, and a writer.

The decoder reads prefix codes (simple and normal, one group or many by an entropy image), back-references and the
colour cache, and undoes the predictor, cross-colour, subtract-green and palette transforms. Of images with one group of codes and
no cache it looks up what a pixel at each bit of a stretch of the stream would be, by vector operations, and then follows the chain
from pixel to pixel; cached and grouped ones are read pixel by pixel.

The writer stores bytes as green pixels by a palette, bundled where there are few, or four to a pixel (alpha, red, green, blue) after the
predictor, cross-colour or subtract-green transform, whichever it expects to be smaller; with prefix codes fitted to the image,
back-references, and the colour cache for images of few colours. Payloads beyond one image's height become several images, one after another.
"""

import struct
import zlib
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from logweave.llm.common import map_rows, texts

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
HASH = 0x1E35A7BD
SIGNATURE = 0x2F
# Fixed values of the format: the 120 short distances by nearness, as yoffset * 16 + 8 - xoffset.
PLANE = (
    0x18, 0x07, 0x17, 0x19, 0x28, 0x06, 0x27, 0x29, 0x16, 0x1A, 0x26, 0x2A, 0x38, 0x05, 0x37, 0x39, 0x15, 0x1B, 0x36, 0x3A,
    0x25, 0x2B, 0x48, 0x04, 0x47, 0x49, 0x14, 0x1C, 0x35, 0x3B, 0x46, 0x4A, 0x24, 0x2C, 0x58, 0x45, 0x4B, 0x34, 0x3C, 0x03,
    0x57, 0x59, 0x13, 0x1D, 0x56, 0x5A, 0x23, 0x2D, 0x44, 0x4C, 0x55, 0x5B, 0x33, 0x3D, 0x68, 0x02, 0x67, 0x69, 0x12, 0x1E,
    0x66, 0x6A, 0x22, 0x2E, 0x54, 0x5C, 0x43, 0x4D, 0x65, 0x6B, 0x32, 0x3E, 0x78, 0x01, 0x77, 0x79, 0x53, 0x5D, 0x11, 0x1F,
    0x64, 0x6C, 0x42, 0x4E, 0x76, 0x7A, 0x21, 0x2F, 0x75, 0x7B, 0x31, 0x3F, 0x63, 0x6D, 0x52, 0x5E, 0x00, 0x74, 0x7C, 0x41,
    0x4F, 0x10, 0x20, 0x62, 0x6E, 0x30, 0x73, 0x7D, 0x51, 0x5F, 0x40, 0x72, 0x7E, 0x61, 0x6F, 0x50, 0x71, 0x7F, 0x60, 0x70,
)


#: Pixels of an image that is read; a small file can claim to be larger, and is an error.
MOST_PIXELS = 1 << 26
#: Payloads whose results a task keeps in mind, at under 1 KB each.
MOST_SEEN = 16_384
#: Images of so few pixels are read one by one, which is quicker for them.
SMALL = 128


class Bits:
    """Bits from the least significant on; beyond the end it is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        i, at = self.at >> 3, self.at & 7
        value = int.from_bytes(self.data[i : i + 4], "little") >> at & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value


#: 16 bits the other way round.
_BACKWARDS = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, ::-1], axis=1).view(">u2").reshape(-1).tolist()


def turned_codes(sizes: list[int]) -> list[int]:
    """Canonical codes of rising sizes, their first bit lowest."""
    out, code, before = [], 0, 0
    for n in sizes:
        code <<= n - before
        before = n
        out.append(_BACKWARDS[code] >> 16 - n)
        code += 1
    return out


#: The same as an array, and what share of all numbers of 16 bits begins with a code of each length.
_TURNED, _SHARES = np.array(_BACKWARDS), 1 << 16 - np.arange(17)


@lru_cache(16)
def backwards(n: int) -> np.ndarray:
    """All numbers of n bits the other way round."""
    return np.array(_BACKWARDS[: 1 << n]) >> 16 - n


#: Bits of a symbol beside the length of its code in one number, and what share of all codes one of each length is.
_SYMBOL_BITS = 12
_SYMBOL, _SHARE = (1 << _SYMBOL_BITS) - 1, [1 << 15 - n for n in range(16)]


def sorted_codes(lengths: list[int]) -> list[int]:
    """Lengths and symbols of a canonical code, as one number each, in order of the codes."""
    return sorted([n << _SYMBOL_BITS | s for s, n in enumerate(lengths) if n])


class Prefix:
    """A canonical prefix code; `table` maps the next `most` bits to (symbol, length)."""

    def __init__(self, lengths: list[int]):
        used = sorted_codes(lengths)
        if not used:
            raise ValueError("a prefix code without symbols")
        self.single = used[0] & _SYMBOL if len(used) == 1 else None
        if self.single is None and sum([_SHARE[x >> _SYMBOL_BITS] for x in used]) != 1 << 15:
            raise ValueError("a prefix code that isn't complete")
        self._used, self.most = used, used[-1] >> _SYMBOL_BITS

    @cached_property
    def array(self) -> np.ndarray:
        """symbol * 16 + length for each of the next `most` bits; a single symbol takes none."""
        if self.single is not None:
            return np.array([self.single << 4])
        n, s = np.divmod(np.array(self._used), 1 << _SYMBOL_BITS)
        # In order of their codes, of which each has its share of all bits that may follow; the first bit is the lowest.
        return np.repeat(s << 4 | n, 1 << self.most - n).take(backwards(self.most))

    @cached_property
    def table(self) -> list[tuple[int, int]]:
        if self.single is not None:
            return [(self.single, 0)]
        out = [(0, 0)] * (1 << self.most)
        sizes = [x >> _SYMBOL_BITS for x in self._used]
        for x, n, code in zip(self._used, sizes, turned_codes(sizes), strict=True):
            out[code :: 1 << n] = [(x & _SYMBOL, n)] * (1 << self.most - n)
        return out

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        symbol, n = self.table[bits.peek(self.most)]
        bits.at += n
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
        return symbol


@lru_cache(4096)
def alone(symbol: int, alphabet: int) -> Prefix:
    """The code of one symbol."""
    if symbol >= alphabet:
        raise ValueError("a symbol beyond the alphabet")
    return Prefix([int(s == symbol) for s in range(alphabet)])


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    x = bits.peek(11)
    if x & 3 == 1:  # a simple code of one symbol, by far the commonest
        wide = x & 4
        bits.read(11 if wide else 4)
        return alone(x >> 3 if wide else x >> 3 & 1, alphabet)
    lengths = [0] * alphabet
    if bits.read(1):
        bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = lengths[bits.read(8)] = 1
        return Prefix(lengths)
    # From here on by plain numbers; bits beyond the end are 0 until the end is checked.
    data, place, code = bits.data, bits.at, [0] * 19
    x = int.from_bytes(data[place >> 3 : (place >> 3) + 9], "little") >> (place & 7)
    n = 4 + (x & 15)
    for i in range(n):
        code[LENGTH_ORDER[i]] = x >> 4 + 3 * i & 7
    bits.at = place + 4 + 3 * n
    code, left = Prefix(code), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    place, table, mask = bits.at, code.table, (1 << code.most) - 1 if code.single is None else 0
    at, before = 0, 8
    x = held = 0
    while at < alphabet and left:
        left -= 1
        if held < 14:  # the longest code of a length and its extra bits
            place -= held
            x, held = int.from_bytes(data[place >> 3 : (place >> 3) + 15], "little") >> (place & 7), 112
            place += held
        s, n = table[x & mask]
        x >>= n
        held -= n
        if s < 16:
            lengths[at] = s
            at += 1
            if s:
                before = s
            continue
        value, n, more = (before, 3 + (x & 3), 2) if s == 16 else (0, 3 + (x & 7), 3) if s == 17 else (0, 11 + (x & 127), 7)
        x >>= more
        held -= more
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    bits.at = place = place - held
    if place > 8 * len(data):
        raise ValueError("the stream ends early")
    return Prefix(lengths)


def _extra(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    n = code - 2 >> 1
    return (2 + (code & 1) << n) + bits.read(n) + 1


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB, row after row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    block, groups, many = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        groups = (read_image(bits, across, -(-height >> block)) >> 8 & 0xFFFF).tolist()
        many = max(groups) + 1
    codes = [[read_prefix(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(many)]
    total = width * height
    if total > MOST_PIXELS:
        raise ValueError("the image is too large")
    if many == 1 and not cache and total > SMALL:
        return _vector(bits, width, total, codes[0])
    out, at = [], 0
    green, red, blue, alpha, far = codes[0]
    if groups is None and not cache and green.single is None and all(c.single is not None for c in (red, blue, alpha)):
        # Single pixels of one coded channel, up to the first back-reference.
        rest = alpha.single << 24 | red.single << 16 | blue.single
        data, place, table, mask, greens = bits.data, bits.at, green.table, (1 << green.most) - 1, bytearray()
        while at < total:
            s, n = table[int.from_bytes(data[place >> 3 : (place >> 3) + 3], "little") >> (place & 7) & mask]
            if s >= 256:
                break
            place += n
            greens.append(s)
            at += 1
        bits.at = place
        if place > 8 * len(data):
            raise ValueError("the stream ends early")
        if at == total:
            return np.frombuffer(greens, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(rest)
        out = [rest | s << 8 for s in greens]
    while at < total:
        if groups is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[groups[(y >> block) * across + (x >> block)]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            p = a << 24 | r << 16 | s << 8 | b
            out.append(p)
            at += 1
            if cache:
                cache[(HASH * p & 0xFFFFFFFF) >> 32 - cache_bits] = p
        elif s < 280:
            n, d = _extra(bits, s - 256), _extra(bits, far.read(bits))
            if d > 120:
                d -= 120
            else:
                k = PLANE[d - 1]
                d = max(1, (k >> 4) * width + 8 - (k & 15))
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + n):
                p = out[i - d]
                out.append(p)
                if cache:
                    cache[(HASH * p & 0xFFFFFFFF) >> 32 - cache_bits] = p
            at += n
        else:
            p = cache[s - 280]
            out.append(p)
            at += 1
            cache[(HASH * p & 0xFFFFFFFF) >> 32 - cache_bits] = p
    return np.array(out, np.uint32)


#: Bits of a stretch that is looked up at once.
_STRETCH = 1 << 15
_PLACES, _SHIFTS = np.arange(_STRETCH + 256), np.arange(8, dtype=np.uint32)[:, None]
# Fixed values of the format: for each prefix symbol of lengths and distances, its extra bits and its least value.
_MORE = np.array([0, 0, 0, 0, *(k - 2 >> 1 for k in range(4, 40))])
_LEAST = np.array([1, 2, 3, 4, *((2 + (k & 1) << (k - 2 >> 1)) + 1 for k in range(4, 40))])
_MASK, _NEAR = (1 << _MORE) - 1, np.array([0, *PLANE])


def _vector(bits: Bits, width: int, total: int, codes: list[Prefix]) -> np.ndarray:
    """Pixels of an image with one group of codes and no cache."""
    green, red, blue, alpha, far = codes
    if all(c.single is not None for c in codes[:4]) and green.single < 256:
        return np.full(total, alpha.single << 24 | red.single << 16 | green.single << 8 | blue.single, np.uint32)
    data = bits.data[bits.at >> 3 :]
    ends, data = 8 * len(data), np.frombuffer(data + bytes(32), np.uint8)
    words, halves = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)), np.ndarray((len(data) - 7,), "<u4", data, strides=(1,))
    per = sum(c.most for c in codes[:4] if c.single is None)
    channels = ((red, 16), (blue, 0), (alpha, 24))
    several, rest = [x for x in channels if x[0].single is None], sum(c.single << place for c, place in channels if c.single is not None)
    at, done, last = bits.at & 7, 0, bits.at & 7
    kinds, values, sizes = [], [], []

    def fetch(where):
        # From a place before the end no pixel reaches beyond the zeros behind it.
        return (words.take(where >> 3) >> (where & 7).view(np.uint64)).view(np.int64)

    def look(code, where):
        """symbol * 16 + length at each place."""
        return code.array.take(fetch(where) & (1 << code.most) - 1) if code.single is None else code.array[0]

    while done < total:
        if at >= ends:
            raise ValueError("the stream ends early")
        begin = at & ~7
        stop = min(64 + min(_STRETCH, (total - done) * per), ends - begin)
        here = _PLACES[:stop]
        if green.single is None:
            # All bytes by each shift in turn, which is quick on long rows: places one after another need no gather.
            near = halves[begin >> 3 : stop + 7 + begin >> 3] >> _SHIFTS & np.uint32((1 << green.most) - 1)
            first = green.array.take(near.astype(np.uint16).T.reshape(-1)[:stop])
        else:
            first = np.full(stop, green.array[0])
        after = here + (first & 15)
        refs = (first >= 256 << 4).nonzero()[0]
        value = None
        for code, place in several:
            c = look(code, begin + after)
            value, after = (c >> 4) << place if value is None else value | (c >> 4) << place, after + (c & 15)
        if len(refs):
            said = first.take(refs)
            k, where = (said >> 4) - 256, refs + (said & 15)
            # At most 10 further bits of the length, 15 of a code and 18 of the distance: one look at the stream has them all.
            x, more = fetch(begin + where), _MORE.take(k)
            lengths = _LEAST.take(k) + (x & _MASK.take(k))
            x >>= more
            c = far.array.take(x & (1 << far.most) - 1) if far.single is None else np.full(len(refs), far.array[0])
            x >>= c & 15
            where += more + (c & 15)
            k = c >> 4
            d = _LEAST.take(k) + (x & _MASK.take(k))
            near = _NEAR[np.minimum(d, 120)]
            back = np.where(d > 120, d - 120, np.maximum(1, (near >> 4) * width + 8 - (near & 15)))
            after[refs] = where + _MORE.take(k)
        # The chain: from every 8th pixel on by doubled steps. Places behind the stretch stay where they are.
        steps = [np.concatenate((after, _PLACES[stop : stop + 128]))]
        for _ in range(3):
            steps.append(steps[-1].take(steps[-1]))
        far_on, now, found = memoryview(steps.pop()), at - begin, []
        while now < stop:
            found.append(now)
            now = far_on[now]
        found = np.array(found)
        for f in reversed(steps):
            both = np.empty(2 * len(found), np.int64)
            both[::2], both[1::2] = found, f.take(found)
            found = both
        at, found = begin + now, found[found < stop]
        said = first.take(found) >> 4
        kind = said >= 256
        mine, pixel = np.ones(len(found), np.int64), (said << 8) + rest
        if value is not None:
            pixel |= value[found]
        if kind.any():
            of = np.searchsorted(refs, found[kind])
            mine[kind], pixel[kind] = lengths[of], back[of]
        passed = done + np.cumsum(mine)
        m = int(np.searchsorted(passed, total)) + 1
        if m <= len(found):
            at = begin + int(after[found[m - 1]])
            kind, pixel, mine, passed = kind[:m], pixel[:m], mine[:m], passed[:m]
        done, last = int(passed[-1]), at
        kinds.append(kind)
        values.append(pixel)
        sizes.append(mine)
    if done > total:
        raise ValueError("a back-reference leaves the image")
    if last > ends:
        raise ValueError("the stream ends early")
    bits.at += last - (bits.at & 7)
    kinds, values, sizes = map(np.concatenate, (kinds, values, sizes))
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(total, np.uint32)
    out[begins[~kinds]] = values[~kinds]
    begins, sizes, values = begins[kinds], sizes[kinds], values[kinds]
    if (values > begins).any():
        raise ValueError("a back-reference leaves the image")
    out = bytearray(out.tobytes())
    for i, n, d in zip((4 * begins).tolist(), (4 * sizes).tolist(), (4 * values).tolist(), strict=True):
        out[i : i + n] = out[i - d : i - d + n] if d >= n else (out[i - d : i] * (n // d + 1))[:n]
    return np.frombuffer(out, np.uint32)


# -- transforms ------------------------------------------------------------------------------------------------------


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _avg(a: int, b: int) -> int:
    return (a & b) + ((a ^ b) >> 1 & 0x7F7F7F7F)


def _add(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _select(left: int, top: int, corner: int) -> int:
    by_left = by_top = 0
    for a, b, c in zip(_channels(left), _channels(top), _channels(corner), strict=True):
        by_left += abs(b - c)
        by_top += abs(a - c)
    return left if by_left < by_top else top


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _full(left: int, top: int, corner: int) -> int:
    a, r, g, b = (_clamp(x + y - z) for x, y, z in zip(_channels(left), _channels(top), _channels(corner), strict=True))
    return a << 24 | r << 16 | g << 8 | b


def _half(mean: int, corner: int) -> int:
    a, r, g, b = (_clamp(x + int((x - y) / 2)) for x, y in zip(_channels(mean), _channels(corner), strict=True))
    return a << 24 | r << 16 | g << 8 | b


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """corner: top left; right: top right."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _avg(_avg(left, right), top)
        case 6:
            return _avg(left, corner)
        case 7:
            return _avg(left, top)
        case 8:
            return _avg(corner, top)
        case 9:
            return _avg(top, right)
        case 10:
            return _avg(_avg(left, corner), _avg(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _full(left, top, corner)
        case 13:
            return _half(_avg(left, top), corner)
    return 0xFF000000


def undo_predictor(image: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    out, across, modes = image.tolist(), -(-width >> block), (modes >> 8 & 15).tolist()
    for at in range(width * height):
        y, x = divmod(at, width)
        if not y:
            guess = out[at - 1] if x else 0xFF000000
        elif not x:
            guess = out[at - width]
        else:
            guess = predict(modes[(y >> block) * across + (x >> block)], out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])
        out[at] = _add(out[at], guess)
    return np.array(out, np.uint32)


def undo_cross_colour(image: np.ndarray, width: int, height: int, block: int, data: np.ndarray) -> np.ndarray:
    across = -(-width >> block)
    y, x = np.divmod(np.arange(width * height), width)
    e = data[(y >> block) * across + (x >> block)]
    signed = lambda v: (v & 0xFF).astype(np.uint8).astype(np.int8).astype(np.int32)
    green = signed(image >> 8)
    red = (image >> 16 & 255).astype(np.int32) + (signed(e) * green >> 5) & 255
    blue = (image & 255).astype(np.int32) + (signed(e >> 8) * green >> 5) + (signed(e >> 16) * signed(red) >> 5) & 255
    return image & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def undo_subtract_green(image: np.ndarray) -> np.ndarray:
    green = image >> 8 & 255
    return image & np.uint32(0xFF00FF00) | (image + (green << np.uint32(16)) & np.uint32(0x00FF0000)) | (image + green & np.uint32(255))


def undo_palette(image: np.ndarray, width: int, height: int, packed: int, table: np.ndarray) -> np.ndarray:
    green, bits = image >> 8 & 255, 8 >> packed
    if packed:
        narrow = -(-width >> packed)
        shifts = np.arange(1 << packed, dtype=np.uint32) * np.uint32(bits)
        green = (green.reshape(height, narrow, 1) >> shifts & np.uint32((1 << bits) - 1)).reshape(height, -1)[:, :width].reshape(-1)
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole.take(green)


def decode_vp8l(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and the pixels (uint32 ARGB, row after row) of a VP8L chunk's data."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            side = read_image(bits, -(-now >> block), -(-height >> block))
            f = undo_predictor if kind == PREDICTOR else undo_cross_colour
            undo.append(lambda im, f=f, w=now, b=block, s=side: f(im, w, height, b, s))
        elif kind == SUBTRACT_GREEN:
            undo.append(undo_subtract_green)
        else:
            n = bits.read(8) + 1
            steps = read_image(bits, n, 1).view(np.uint8).reshape(n, 4)
            colours = np.cumsum(steps, 0, dtype=np.uint8).reshape(-1).view(np.uint32)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda im, w=now, p=packed, t=colours: undo_palette(im, w, height, p, t))
            now = -(-now >> packed)
    image = read_image(bits, now, height, main=True)
    for f in reversed(undo):
        image = f(image)
    return width, height, image


def images(data: bytes) -> list[bytes]:
    """The VP8L data of each of the files that follow one another in `data`."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("no WebP file")
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        inner = at + 12
        while inner + 8 <= end:
            kind, n = data[inner : inner + 4], struct.unpack_from("<I", data, inner + 4)[0]
            if kind == b"VP8L":
                out.append(data[inner + 8 : inner + 8 + n])
            inner += 8 + n + (n & 1)
        at = end + (end & 1)
    return out


def pixel_arrays(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    return [decode_vp8l(x) for x in images(data)]


# -- writing ---------------------------------------------------------------------------------------------------------

#: Pixels to a row of green images and of those with four bytes to a pixel, and the most rows of an image.
ONE, ROW, MOST_ROWS = 64, 16, 16_383
#: Bytes that make a back-reference, the longest one, and the farthest.
MATCH, LONGEST, FARTHEST = 8, 4096, (1 << 20) - 120
#: Bits that a symbol takes in the table of a code, about; and multipliers that are tried, in 32nds.
_PER_SYMBOL = 6
_FACTORS = (8, 16, 24, 40, 48)


#: A code, or another value, and its number of bits so much higher.
_BITS = 32


class Writer:
    """Values of at most 32 bits and their numbers of bits, the lowest bit first; a value of no bits is 0."""

    def __init__(self):
        self.held, self.bits, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.bits
        self.bits += n

    def put_all(self, both: np.ndarray) -> None:
        """Values with their numbers of bits, `_BITS` higher."""
        words = -(-self.bits >> 5)
        sizes = np.full(words, 32)
        sizes[-1:] -= 32 * words - self.bits
        self.parts.append((np.frombuffer(self.held.to_bytes(4 * words, "little"), "<u4").astype(np.int64), sizes))
        if len(both):
            self.parts.append((both & (1 << _BITS) - 1, both >> _BITS))
        self.held = self.bits = 0

    def done(self) -> bytes:
        self.put_all(np.zeros(0, np.int64))
        values, sizes = map(np.concatenate, zip(*self.parts, strict=True))
        ends = np.cumsum(sizes)
        place = ends - sizes
        # What begins in one 32-bit word reaches into the next one at most.
        word, values = place >> 5, values << (place & 31)
        begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sums = np.add.reduceat(values.view(np.uint64), begins)
        word, whole = word[begins], np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        whole[word] = sums & np.uint64(0xFFFFFFFF)
        whole[word + 1] |= sums >> np.uint64(32)
        return whole.astype("<u4").tobytes()[: int(ends[-1] + 7 >> 3)]


def fitted(counts: list[int], most: int) -> list[int]:
    """Code lengths of at most `most` bits, by joining the rarest; a single symbol has length 1."""
    used = sorted([c << _SYMBOL_BITS | i for i, c in enumerate(counts) if c])
    out, n = [0] * len(counts), len(used)
    if n < 2:
        for x in used:
            out[x & _SYMBOL] = 1
        return out
    weights = [x >> _SYMBOL_BITS for x in used]
    end = 1 + 2 * sum(weights)
    while True:
        # Symbols and joined ones are two rising queues, each with an end above all.
        joined, above, i, j = [end], [0] * (2 * n - 1), 0, 0
        weights[n:] = [end]
        for k in range(n, 2 * n - 1):
            a, b = weights[i], joined[j]
            if a <= b:
                above[i] = k
                i += 1
            else:
                a = b
                above[n + j] = k
                j += 1
            c, b = weights[i], joined[j]
            if c <= b:
                above[i] = k
                i += 1
            else:
                c = b
                above[n + j] = k
                j += 1
            joined[-1:] = (a + c, end)
        above[-1] = 0
        for k in range(2 * n - 3, -1, -1):  # from a place above to a depth
            above[k] = above[above[k]] + 1
        if above[0] <= most:
            for x, depth in zip(used, above, strict=False):
                out[x & _SYMBOL] = depth
            return out
        weights = [c + 1 >> 1 for c in weights[:n]]


def table_of(lengths: list[int], symbols: list[int]) -> np.ndarray:
    """Code and, `_BITS` higher, number of bits for each symbol, of which `symbols` have codes; a single symbol takes none."""
    out = np.zeros(len(lengths), np.int64)
    if len(symbols) > 1:
        used = np.array(sorted([lengths[s] << _SYMBOL_BITS | s for s in symbols]))
        n = used >> _SYMBOL_BITS
        share = _SHARES.take(n)
        out[used & _SYMBOL] = _TURNED.take(np.cumsum(share) - share) | n << _BITS
    return out


#: The four bits of a simple code of the one symbol 0.
ZERO = 1
#: Code lengths as they are said: symbol, extra, its bits.
_PLAIN = [(n, 0, 0) for n in range(16)]


def write_prefix(w: Writer, lengths: list[int]) -> np.ndarray:
    """Writes the code, and gives its table."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2 and (not used or used[0] < 256):
        s = used[0] if used else 0
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(s > 1), 1)
        w.put(s, 8 if s > 1 else 1)
        return table_of(lengths, used)
    w.put(0, 1)
    said, at = [], 0  # (symbol, extra, its bits)
    for s in (*used, len(lengths)):
        if s > at:
            zeros = s - at
            while zeros >= 3:
                n = min(zeros, 138)
                said.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
                zeros -= n
            said += [_PLAIN[0]] * zeros
        if s < len(lengths):
            said.append(_PLAIN[lengths[s]])
        at = s + 1
    counts = [0] * 19
    for s, _, _ in said:
        counts[s] += 1
    small = fitted(counts, 7)
    n = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if small[s]))
    w.put(n - 4, 4)
    held = 0
    for i, s in enumerate(LENGTH_ORDER[:n]):
        held |= small[s] << 3 * i
    w.put(held, 3 * n + 1)
    order, held, bits = sorted_codes(small), 0, 0
    sizes = [x >> _SYMBOL_BITS for x in order] if len(order) > 1 else [0]
    table = {x & _SYMBOL: code for x, code in zip(order, zip(turned_codes(sizes), sizes, strict=True), strict=True)}
    for s, extra, more in said:
        code, n = table[s]
        held |= (code | extra << n) << bits
        bits += n + more
    w.put(held, bits)
    return table_of(lengths, used)


def repeats(keys: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Back-references (start, length, distance) by the last earlier place of equal keys, each of k pixels; none overlaps another."""
    if len(keys) < 2:
        return []
    # By 16 bits of a hash: quick to sort, and where another key comes between two equal ones, that reference is not found.
    order = np.argsort((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    sorted_ = keys.take(order)
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    later = order.take(same + 1)
    far = np.zeros(len(keys), np.int64)
    far[later] = later - order.take(same)
    far[far > FARTHEST] = 0
    edge = np.flatnonzero(far[1:] != far[:-1]) + 1
    begin, end = np.concatenate(([0], edge)), np.concatenate((edge + (k - 1), [len(far) + k - 1]))
    back = far.take(begin)
    any_ = np.flatnonzero(back)
    out, done = [], 0
    for a, end, d in zip(begin.take(any_).tolist(), end.take(any_).tolist(), back.take(any_).tolist(), strict=True):
        if a < done:
            a = done
        while end - a >= k:
            n = end - a
            if n > LONGEST:
                n = LONGEST
            out.append((a, n, d))
            a = done = a + n
    return out


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and its bits for numbers from 1 on."""
    s = np.searchsorted(_LEAST, x, side="right") - 1
    return s, x - _LEAST[s], _MORE[s]


def write_image(w: Writer, channels: list[np.ndarray | None], refs: list[tuple[int, int, int]], main: bool = False, cache_bits: int = 0) -> None:
    """channels: green, red, blue and alpha of each pixel; None: all 0."""
    green, n = channels[0], len(channels[0])
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    alphabet = 280 + (1 << cache_bits if cache_bits else 0)
    free = slice(None)
    if refs:
        start, length, back = np.array(refs, np.int64).T
        inside = np.zeros(n + 1, np.int8)
        inside[start] += 1
        inside[start + length] -= 1
        free = np.cumsum(inside[:-1], dtype=np.int8) == 0
        ls, lx, lb = _coded(length)
        ds, dx, db = _coded(back + 120)
    said, cached = green[free], None
    if cache_bits:
        free = free if refs else np.ones(n, bool)
        green, cached = _cached(channels, free, cache_bits)
        said = green[free]
    counts = np.bincount(said, minlength=alphabet)
    if refs:
        counts += np.bincount(256 + ls, minlength=alphabet)
    codes = write_prefix(w, fitted(counts.tolist(), 15))
    columns = [codes.take(green)]
    for c in channels[1:]:
        if c is None:
            w.put(ZERO, 4)
            continue
        counted = c[free] if cached is None else c[free & ~cached]
        mine = write_prefix(w, fitted(np.bincount(counted, minlength=256).tolist(), 15) if len(counted) else [0] * 256).take(c)
        columns.append(mine if cached is None else np.where(cached, 0, mine))
    both = columns[0][:, None] if len(columns) == 1 else np.stack(columns, 1)
    if not refs:
        w.put(ZERO, 4)
    else:
        last = write_prefix(w, fitted(np.bincount(ds, minlength=40).tolist(), 15))
        # A reference's four values stand in the place of its first pixels, of which it has as many as that takes.
        rows = -(-4 // both.shape[1])
        cells = np.zeros((len(refs), rows * both.shape[1]), np.int64)
        for i, x in enumerate((codes[256 + ls], lx | lb << _BITS, last[ds], dx | db << _BITS)):
            cells[:, i] = x
        place = (start[:, None] + np.arange(rows)).reshape(-1)
        both[place] = cells.reshape(-1, both.shape[1])
        free[place] = True
        both = both[free]
    w.put_all(both.reshape(-1))


def _cached(channels: list[np.ndarray], free: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Green symbols, with cache symbols for the pixels outside references that the cache has; and which those are."""
    g, r, b, a = (np.zeros(len(free), np.int64) if c is None else c.astype(np.int64) for c in channels)
    pixels = (a << 24 | r << 16 | g << 8 | b).tolist()
    cache, out = [0] * (1 << bits), []
    for p, own in zip(pixels, free.tolist(), strict=True):
        k = (HASH * p & 0xFFFFFFFF) >> 32 - bits
        out.append(280 + k if own and cache[k] == p else p >> 8 & 255)
        cache[k] = p
    out = np.array(out, np.int64)
    return out, out >= 280


def _expected(channels: list[np.ndarray]) -> float:
    """Bits that an image takes, about, without references."""
    total = 0.0
    for c in channels:
        n = np.bincount(c, minlength=256)
        n = n[n > 0]
        if len(n) > 1:
            total += float(len(c) * np.log2(len(c)) - n @ np.log2(n)) + _PER_SYMBOL * len(n)
    return total


def _parts(p: np.ndarray) -> list[np.ndarray]:
    return [(p >> np.uint32(k) & np.uint32(255)).astype(np.uint8) for k in (8, 16, 0, 24)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int8).astype(np.int32)


def _four(p: np.ndarray) -> tuple[float, tuple, list[np.ndarray]]:
    """The best of the transforms for an image of four bytes to a pixel: expected bits, (kind, what it needs), channels."""
    plain = _parts(p)
    g, r, b, a = plain
    ways = [(_expected(plain), (None, 0), plain)]
    less = [g, r - g, b - g, a]
    ways.append((_expected(less), (SUBTRACT_GREEN, 0), less))
    left, top = np.concatenate(([0xFF000000], p[:-1])).astype(np.uint32), np.concatenate((p[:0], p[:-ROW]))
    for mode in (1, 2):
        guess = left.copy()
        guess[ROW::ROW] = p[: len(p) - ROW : ROW]
        if mode == 2:
            guess[ROW:] = top
        rest = [x - y for x, y in zip(plain, _parts(guess), strict=True)]
        ways.append((_expected(rest), (PREDICTOR, mode), rest))
    for e in _FACTORS:
        by = (_signed(np.array([e])) * _signed(g) >> 5).astype(np.uint8)
        rest = [g, r - by, b - by, a]
        ways.append((_expected(rest), (CROSS_COLOUR, e), rest))
    return min(ways, key=lambda x: x[0])


def _few(p: np.ndarray) -> bool:
    """Whether an image of four bytes to a pixel has few colours, or few steps from pixel to pixel; others aren't tried."""

    def few(x):
        x = np.sort(x)
        return 3 * (np.count_nonzero(x[1:] != x[:-1]) + min(1, len(x))) < len(p)

    return few(p) or few(p[1:] - p[:-1])


def _write_image(part: np.ndarray) -> bytes:
    """A WebP file of a positive multiple of 64 bytes."""
    w, n = Writer(), len(part)
    values = np.flatnonzero(np.bincount(part, minlength=256)).astype(np.uint8)
    numbers = np.zeros(256, np.uint8)
    numbers[values] = np.arange(len(values))
    index = numbers[part]
    four = part.view(">u4").astype(np.uint32)
    best = _four(four) if _few(four) else None
    one = best is None or best[0] >= _expected([index])
    width = ONE if one else ROW
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(n // (ONE if one else 4 * ROW) - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    if one:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(values) - 1, 8)
        steps = values.copy()
        steps[1:] -= values[:-1]
        write_image(w, [steps, None, None, None], [])
        packed = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1 if len(values) <= 16 else 0
        if packed:
            shifts = np.arange(1 << packed, dtype=np.uint8) * np.uint8(8 >> packed)
            index = np.bitwise_or.reduce(index.reshape(-1, 1 << packed) << shifts, axis=1)
        keys = np.ndarray((max(0, len(index) - MATCH + 1),), "<u8", index.tobytes(), strides=(1,))
        w.put(0, 1)
        write_image(w, [index, None, None, None], repeats(keys, MATCH), main=True)
    else:
        _, (kind, what), channels = best
        if kind is not None:
            w.put(1, 1)
            w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(7, 3)  # blocks of 512 pixels a side
            blocks = -(-(n // (4 * ROW)) >> 9)
            same = lambda x: np.full(blocks, x, np.uint8)
            # The mode is in green; of multipliers, green to red is in blue and green to blue in green.
            write_image(w, [same(what), same(0), same(what if kind == CROSS_COLOUR else 0), same(255)], [])
        w.put(0, 1)
        g, r, b, a = (c.astype(np.uint64) for c in channels)
        p = a << np.uint64(24) | r << np.uint64(16) | g << np.uint64(8) | b
        colours = len(np.unique(p))
        write_image(w, channels, repeats(p[:-1] << np.uint64(32) | p[1:], 2), main=True, cache_bits=min(10, max(1, colours.bit_length())) if 4 * colours < len(p) else 0)
    data = w.done()
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def store(payload: bytes) -> bytes:
    """payload: a positive multiple of 64 bytes."""
    data, step = np.frombuffer(payload, np.uint8), ONE * MOST_ROWS
    return b"".join(_write_image(data[i : i + step]) for i in range(0, len(data), step))


def read_back(media: bytes) -> tuple[bytes, str]:
    """The payload in the pixels of stored images, and the sizes of the images."""
    found = pixel_arrays(media)
    parts = [(p >> np.uint32(8)).astype(np.uint8) if w == ONE else p.astype(">u4") for w, _, p in found]
    return b"".join(x.tobytes() for x in parts), ",".join(f"{w}x{h}" for w, h, _ in found)


def feature(payload: bytes, sizes: str) -> str:
    """Image sizes, mean sample, number of distinct samples, and entropy in thousandths of a bit, from the pixels."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n[n > 0] / len(payload)
    return f"{sizes};mean={int(n @ np.arange(256)) * 1000 // len(payload)};distinct={len(p)};entropy={round(float(-(p * np.log2(p)).sum()) * 1000)}"


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored as lossless images; null counts as the empty text."""

    def rows(source):
        for doc_id, text in source:
            payload, n = padded(text)
            yield doc_id, n, store(payload)

    return map_rows(texts(docs, id_col, text_col), rows, "doc_id bigint, n_bytes bigint, media binary")


def pixels(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row an image: (doc_id, image, width, height, argb binary big-endian, error); a bad or null file gives one row with its error."""

    def rows(source):
        for doc_id, data in source:
            try:
                if data is None:
                    raise ValueError("null")
                for i, (w, h, p) in enumerate(pixel_arrays(bytes(data))):
                    yield doc_id, i, w, h, p.astype(">u4").tobytes(), None
            except (ValueError, IndexError, struct.error) as e:
                yield doc_id, None, None, None, None, str(e)[:200]

    return map_rows(media.select(id_col, media_col), rows, f"{id_col} bigint, image int, width int, height int, argb binary, error string")


def described(source):
    """The rows of `digests`; of a task's equal payloads, as long as they are kept in mind, one is stored and read back."""
    seen = {}
    for doc_id, text in source:
        payload, n = padded(text)
        key = sha256(payload).digest()
        if key not in seen:
            if len(seen) >= MOST_SEEN:
                seen.clear()
            media = store(payload)
            back, sizes = read_back(media)
            seen[key] = len(back), sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha256(media).hexdigest(), feature(back, sizes)
        yield doc_id, n, *seen[key]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text, reads the stored bytes back, and describes both; long columns never leave the worker.

    Null counts as the empty text (64 zero bytes); repeated rows give repeated rows; other columns aren't read.
    """

    return map_rows(texts(docs, id_col, text_col), described, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
