"""Emission patterns: hexadecimal profiles, bits, runs, angle codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_bits(code: Column, elements: int) -> Column:
    """Bits (0/1 string), most significant first; padded with zeros at the right or cut to the number of elements. A code of f alone: all ones."""
    plain = F.regexp_replace(code, "[ \\n]", "")
    # Digits 0 and 1 make way first, as the bits are written with them.
    nibbles = F.translate(F.lower(plain), "01", "gh")
    for k, digit in enumerate("gh23456789abcdef"):
        nibbles = F.replace(nibbles, F.lit(digit), F.lit(f"{k:04b}"))
    full = F.when(plain.rlike("^[fF]+$"), F.lit("1" * elements))
    return full.when(plain.rlike("^[0-9a-fA-F]+$"), F.rpad(nibbles, elements, "0")).otherwise(F.lit("0" * elements))


def bits_to_hex(bits: Column) -> Column:
    """Groups of four bits, most significant first; the last group is padded with zeros at the right. No bits: no digits."""
    # Each group ends in a blank, which a group's four bits precede nowhere else.
    groups = F.regexp_replace(F.rpad(bits, (F.ceil(F.length(bits) / 4) * 4).cast("int"), F.lit("0")), "(.{4})", "$1 ")
    for k in range(16):
        groups = F.replace(groups, F.lit(f"{k:04b} "), F.lit(f"{k:x}"))
    return groups


def mirrored(bits: Column) -> Column:
    return F.reverse(bits)


def longest_run(bits: Column, digit: str) -> Column:
    other = "0" if digit == "1" else "1"
    return F.array_max(F.transform(F.split(bits, other), F.length))


def first_run(bits: Column) -> Column:
    return F.length(F.regexp_extract(bits, "^(0+|1+)", 1))


def angle_code(angle: Column) -> Column:
    """1 for negative or 0, and two digits of the absolute whole angle."""
    return F.concat(F.when(angle < 0, "1").otherwise("0"), F.lpad(F.abs(angle.cast("int")).cast("string"), 2, "0"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def angle_of(name: Column) -> Column:
    """The angle in the last part of a name hex_angle: its sign (0 or 1) and all digits after it; null if there is none."""
    code = F.regexp_replace(F.element_at(F.split(base_name(name), "_"), -1), "\\.", "")
    size = F.substr(code, F.lit(2)).try_cast("int")
    return F.when(code.rlike("^1[0-9]+$"), -size).when(code.rlike("^0[0-9]+$"), size)


def flipped_code(code: Column) -> Column:
    return F.when(code == "000", code).when(code.startswith("0"), F.concat(F.lit("1"), F.substr(code, F.lit(2)))).otherwise(F.concat(F.lit("0"), F.substr(code, F.lit(2))))


def delay_law(angle_deg: Column, elements: int, width: float, speed: float) -> Column:
    """Delays in ms of every element for a plane wave; the smallest, that of the first or the last element, is zero."""
    slope = 1000.0 / speed * F.sin(F.radians(angle_deg)) * width
    return F.transform(F.sequence(F.lit(1), F.lit(elements)), lambda i: slope * i - F.when(slope < 0, slope * elements).otherwise(slope))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where ``use`` needs it for every element of an array."""
    return F.transform(F.array(value), use)[0]


def phase_of(bits: Column) -> Column:
    """Quarter turns 0 to 3 from the first run: its digit, and whether it is about half of the longest run."""
    longest = F.greatest(longest_run(bits, "0"), longest_run(bits, "1"))
    share = first_run(bits) / longest
    shifted = (share > 0.3) & (share < 0.7)
    starts_high = F.substr(bits, F.lit(1), F.lit(1)) == "1"
    return F.when(bits == "", 0).when(starts_high, F.when(shifted, 0).otherwise(1)).otherwise(F.when(shifted, 2).otherwise(3))


def striped(low: Column, high: Column, head: Column, tail: Column, size: int) -> Column:
    """Bits: runs of ``low`` zeros and ``high`` ones repeated to the size; ``head`` digits leave the head for zeros at the tail, ``tail`` ones move from the tail to the head."""
    unit = F.concat(F.repeat(F.lit("0"), low), F.repeat(F.lit("1"), high))
    bits = F.substr(F.repeat(unit, F.ceil(F.lit(size) / F.length(unit)).cast("int")), F.lit(1), F.lit(size))
    bits = F.concat(F.substr(bits, head + 1, F.lit(size)), F.repeat(F.lit("0"), head))
    return F.concat(F.repeat(F.lit("1"), tail), F.substr(bits, F.lit(1), F.lit(size) - tail))


def square_wave(elements: int, pitch: float, frequency: Column, kind: str) -> Column:
    """Bits of the elements where the cosine or sine of their centred position is positive."""
    wave = {"cos": F.cos, "sin": F.sin}[kind]
    turn = lambda i: wave(2 * F.pi() * frequency * ((i - (elements - 1) / 2) * pitch))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(elements - 1)), lambda i: F.when(turn(i) > 0, "1").otherwise("0")), "")


def bits_to_hex_reversed(bits: Column) -> Column:
    """Least significant bit first: as bits_to_hex of the mirrored bits, filled up with zeros to whole digits."""
    return bits_to_hex(F.reverse(F.rpad(bits, (F.ceil(F.length(bits) / 4) * 4).cast("int"), F.lit("0"))))


def angle_of_delays(delays: Column, pitch: float, speed: float) -> Column:
    """Steering angle in whole degrees: slope of the regression of delays (s) on element position, signed by the side of the largest."""

    def angle(d: Column) -> Column:
        n = F.size(d)
        moment = F.aggregate(F.transform(d, lambda v, i: (i - (n - 1) / 2) * v), F.lit(0.0), lambda s, v: s + v)
        slope = moment / (pitch * n * (n * n - 1) / 12)
        size = F.abs(F.degrees(F.asin(slope * speed)))
        top, half = F.array_position(d, F.array_max(d)) - 1, F.floor(n / 2)
        return F.rint(F.when(top < half, -size).when(top > half, size).otherwise(0.0)).cast("int")

    return let(delays, angle)


def focus_delays(elements: int, pitch: float, focus_x: Column, focus_z: Column, speed: float) -> Column:
    """Delays in s that bring every element's wave to the focus at one time: the farthest fires first."""
    way = F.transform(F.sequence(F.lit(0), F.lit(elements - 1)), lambda i: F.sqrt(F.pow((i - (elements - 1) / 2) * pitch - focus_x, F.lit(2)) + focus_z * focus_z) / speed)
    return let(way, lambda w: let(F.array_max(w), lambda top: F.transform(w, lambda d: top - d)))


def rotation_centre(positions: list[float], angle: Column, delays: Column, bits: Column, speed: float) -> Column:
    """x where the wave front's line meets the probe; 0 without active elements or for a flat front. Delays in s."""
    a = F.round(angle, 5)
    first, last = F.element_at(delays, 1) * speed, F.element_at(delays, -1) * speed
    x_first, x_last = F.lit(positions[0]) - F.sin(a) * first, F.lit(positions[-1]) - F.sin(a) * last
    z_first, z_last = -F.cos(a) * first, -F.cos(a) * last
    flat = (z_last == z_first) | ~bits.contains("1")
    return F.when(flat, 0.0).otherwise((z_last * x_first - z_first * x_last) / F.nullif(z_last - z_first, F.lit(0.0)))


def steered_window(x: Column, z: Column, angle_deg: Column, width: float, alpha: float = 0.3, divergence_deg: float = 0.5) -> Column:
    """Weight of a point in the steered, slowly widening beam: 1 inside, cosine edge of share alpha, 0 outside."""
    half = width / 2 + z * F.tan(F.radians(F.lit(divergence_deg)))
    at = F.abs((x - z * F.tan(F.radians(angle_deg))) / half)
    edge = 0.5 * (1 + F.cos(F.pi() * (at - (1 - alpha)) / alpha)) if alpha > 0 else F.lit(0.0)
    return F.when(at <= 1 - alpha, 1.0).when(at <= 1, edge).otherwise(0.0)


def next_power_of_2(n: Column) -> Column:
    return F.pow(F.lit(2), F.ceil(F.log2(n))).cast("long")


def target_size(size: Column, step: Column, target: Column) -> Column:
    """Samples at the target step over the same length; two at least."""
    return F.greatest(F.lit(2), F.floor(size * step / target + 1e-9))


def pattern_of(name: Column) -> Column:
    """The parts of a file's name between its first and its last underscore, put together."""
    parts = F.split(base_name(name), "_")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "")


def field_name(code: Column, angle: Column) -> Column:
    return F.concat(F.lit("field_"), code, F.lit("_"), angle_code(angle))


def pattern_paths(folder: str, code: Column, angles: Column) -> Column:
    """Paths of the fields of a pattern, one for each of an array of angles."""
    return F.transform(angles, lambda a: F.concat(F.lit(folder + "/"), field_name(code, a), F.lit(".hdr")))


def plane_wave_angle(angle: Column) -> Column:
    """The angle; an error outside -20 to 20 degrees."""
    return F.when(F.abs(angle) > 20, F.raise_error(F.lit("a plane wave's angle lies between -20 and 20 degrees")).cast("double")).otherwise(angle)
