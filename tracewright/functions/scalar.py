"""Scalar functions as column expressions: bit and byte functions, labels, quantiles, thresholds,
window coefficients and display mappings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.model import byte_at


def hamming_weight(x: Column) -> Column:
    return F.bit_count(x)


def aes_sbox() -> list[int]:
    """The AES S-box from its definition: inverse in GF(2^8), then the affine map."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a = (a << 1) ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out

    table = []
    for x in range(256):
        inverse = next((y for y in range(256) if times(x, y) == 1), 0)
        rotated = [(inverse << k | inverse >> (8 - k)) & 0xFF for k in range(5)]
        value = 0x63
        for r in rotated:
            value ^= r
        table.append(value)
    return table


SBOX = aes_sbox()


def sbox(x: Column, key: int = 0) -> Column:
    return F.get(F.array(*[F.lit(v) for v in SBOX]), x.bitwiseXOR(F.lit(key)).cast("int"))


def byte_class(byte: Column, mode: str = "byte", key: int = 0) -> Column:
    """Class of a data byte: ``byte``, ``hw``, ``sbox`` or ``hw_sbox``."""
    return {"byte": lambda: byte, "hw": lambda: F.bit_count(byte), "sbox": lambda: sbox(byte, key), "hw_sbox": lambda: F.bit_count(sbox(byte, key))}[mode]()


def n_classes(mode: str) -> int:
    return 9 if mode.startswith("hw") else 256


def read_int(data: Column, offset: int, length: int, big_endian: bool = False) -> Column:
    """Unsigned integer of up to 8 bytes, cut at the end of the data; decimal(20,0)."""
    length = min(length, 8)
    total = F.lit(0).cast("decimal(20,0)")
    have = F.greatest(F.lit(0), F.least(F.lit(length), F.octet_length(data) - offset))
    for i in range(length):
        power = F.lit(256.0) ** ((have - 1 - i) if big_endian else F.lit(i))
        total = (total + F.coalesce(byte_at(data, offset + i).cast("decimal(20,0)") * power.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))).cast("decimal(20,0)")
    return total


def label_raw(data: Column, offset: int, length: int, big_endian: bool = False) -> Column:
    return read_int(data, offset, length, big_endian)


def label_hw(data: Column, offset: int, length: int = 1) -> Column:
    """Summed bit counts of the bytes; 0 past the end."""
    return sum((F.coalesce(F.bit_count(byte_at(data, offset + i)), F.lit(0)) for i in range(length)), F.lit(0))


def label_bit(data: Column, offset: int, bit: int) -> Column:
    return F.coalesce(F.shiftright(byte_at(data, offset), bit).bitwiseAND(F.lit(1)), F.lit(0))


def label_bit_range(data: Column, offset: int, low: int, high: int) -> Column:
    """Bits low..high of a byte as a number."""
    return F.coalesce(F.shiftright(byte_at(data, offset), low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1)), F.lit(0))


def label_type(kind: str, length: int) -> str:
    """Spark type that holds a label: raw values by byte count, everything else one byte."""
    if kind != "raw":
        return "smallint"
    return {1: "smallint", 2: "int"}.get(length, "bigint" if length <= 4 else "decimal(20,0)")


def param_value(data: Column, offset: int, length: int, kind: int) -> Column:
    """A named parameter as an integer: little-endian, sign-extended unless its type is 1 (byte)."""
    value = read_int(data, offset, length)
    if kind == 1:
        return value
    return F.when(value >= F.lit(2 ** (8 * min(length, 8) - 1)).cast("decimal(20,0)"), value - F.lit(2 ** (8 * min(length, 8))).cast("decimal(20,0)")).otherwise(value)


def hex_dump(data: Column) -> Column:
    """Lower-case hex in groups of four bytes."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(data)), "(.{8})", "$1 "))


def block_halves(data: Column) -> tuple[Column, Column]:
    """The two 16-byte halves of 32-byte data, as hex; null for other lengths."""
    whole = F.octet_length(data) == 32
    return F.when(whole, hex_dump(F.substring(data, 1, 16))), F.when(whole, hex_dump(F.substring(data, 17, 16)))


# Rational approximation 26.2.17 of Abramowitz and Stegun's handbook (normal quantile).
NORMAL_NUMERATOR = (2.515517, 0.802853, 0.010328)
NORMAL_DENOMINATOR = (1.432788, 0.189269, 0.001308)


def inv_norm(p: Column) -> Column:
    """Standard normal quantile; plus or minus 1e300 at the bounds."""
    tail = F.when(p < 0.5, p).otherwise(F.lit(1.0) - p)
    t = F.sqrt(F.lit(-2.0) * F.ln(F.greatest(tail, F.lit(1e-320))))
    c, d = NORMAL_NUMERATOR, NORMAL_DENOMINATOR
    x = t - (F.lit(c[0]) + F.lit(c[1]) * t + F.lit(c[2]) * t * t) / (F.lit(1.0) + F.lit(d[0]) * t + F.lit(d[1]) * t * t + F.lit(d[2]) * t * t * t)
    return F.when(p <= 0, F.lit(-1e300)).when(p >= 1, F.lit(1e300)).when(p < 0.5, -x).otherwise(x)


def inv_t(p: Column, df: Column) -> Column:
    """Student t quantile by the Cornish-Fisher expansion; normal from 200 degrees on."""
    z = inv_norm(p)
    g1 = (z**3 + z) / 4
    g2 = (F.lit(5.0) * z**5 + F.lit(16.0) * z**3 + F.lit(3.0) * z) / 96
    safe = F.greatest(df, F.lit(1e-12))
    return F.when(df >= 200, z).otherwise(z + g1 / safe + g2 / (safe * safe))


def sidak(alpha: Column, n: Column) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - alpha, F.lit(1.0) / n)


def threshold(alpha: Column, n: Column, median_df: Column) -> Column:
    """|t| limit of a family of n tests at level alpha."""
    return inv_t(F.lit(1.0) - sidak(alpha, n) / 2, median_df)


def nu_approx(n0: Column, n1: Column) -> Column:
    """Welch degrees of freedom of two groups of equal variance."""
    a, b = F.lit(1.0) / n0, F.lit(1.0) / n1
    return F.when((n0 > 1) & (n1 > 1), (a + b) * (a + b) / (a * a / F.greatest(n0 - 1, F.lit(1)) + b * b / F.greatest(n1 - 1, F.lit(1)))).otherwise(F.lit(0.0))


def window_coefficient(kind: str, i: Column, n: Column) -> Column:
    """Symmetric window of n points: rect, hann, hamming or blackman."""
    x = F.when(n > 1, F.lit(2 * math.pi) * i / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
    return {
        "rect": lambda: F.lit(1.0),
        "hann": lambda: F.lit(0.5) - F.lit(0.5) * F.cos(x),
        "hamming": lambda: F.lit(0.54) - F.lit(0.46) * F.cos(x),
        "blackman": lambda: F.lit(0.42) - F.lit(0.5) * F.cos(x) + F.lit(0.08) * F.cos(F.lit(2.0) * x),
    }[kind]()


def decibel(magnitude: Column) -> Column:
    """20 log10, not below -200."""
    return F.when(magnitude > 1e-10, F.lit(20.0) * F.log10(magnitude)).otherwise(F.lit(-200.0))


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def heat_gamma(v: Column, low: Column, high: Column, gamma: float) -> Column:
    """Gamma on the place of v between low and high, mapped back to that range."""
    place = F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / F.when(high > low, high - low)))).otherwise(F.lit(0.0))
    return low + F.pow(place, F.lit(float(gamma))) * (high - low)


def heat_binary(v: Column, limit: float) -> Column:
    return F.when(v >= limit, F.lit(1.0)).otherwise(F.lit(0.0))


# Stops of the display palettes (place, red, green, blue).
PALETTES = {
    "diverging": ((0.0, 5, 113, 176), (0.25, 146, 197, 222), (0.5, 247, 247, 247), (0.75, 244, 165, 130), (1.0, 202, 0, 32)),
    "gray": ((0.0, 0, 0, 0), (1.0, 255, 255, 255)),
    "hot": ((0.0, 0, 0, 0), (0.33, 255, 0, 0), (0.67, 255, 255, 0), (1.0, 255, 255, 255)),
    "viridis": ((0.0, 68, 1, 84), (0.25, 59, 82, 139), (0.5, 33, 145, 140), (0.75, 94, 201, 98), (1.0, 253, 231, 37)),
    "plasma": ((0.0, 13, 8, 135), (0.25, 156, 23, 158), (0.5, 237, 104, 60), (0.75, 246, 200, 33), (1.0, 240, 249, 33)),
    "green": ((0.0, 0, 0, 0), (1.0, 0, 255, 0)),
}


def color_place(v: Column, lo: Column, hi: Column) -> Column:
    """Place of a value in a display range; the middle where the range is empty."""
    return F.when(hi == lo, F.lit(0.5)).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)))


def colormap(place: Column, palette: str = "gray") -> Column:
    """Packed RGB of a place in [0, 1], by linear pieces with truncation."""
    stops = PALETTES[palette]
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), place))
    out = None
    for (p, *a), (q, *b) in zip(stops, stops[1:], strict=False):
        f = (x - F.lit(p)) / F.lit(q - p)
        r, g, c = (F.floor(F.lit(float(i)) + F.lit(float(j - i)) * f).cast("int") for i, j in zip(a, b, strict=True))
        rgb = r * 65536 + g * 256 + c
        out = F.when(x <= q, rgb) if out is None else out.when(x <= q, rgb)
    return out


def sample_to_pixel(s: Column, start: int, length: int, width: int) -> Column:
    return F.floor((s - start) * width / F.lit(length)).cast("long")


def pixel_to_sample(p: Column, start: int, length: int, width: int) -> Column:
    return (F.lit(start) + F.floor(p * length / F.lit(width))).cast("long")
