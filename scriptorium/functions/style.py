"""Colours, lanes and classes of speakers; contrast; geometry of images and circles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first group with a keyword in the tone names its emoji.
TONES = [
    (("angry", "furious", "rage", "mad", "irritated"), "💢"),
    (("sad", "cry", "sob", "weep", "tears"), "💧"),
    (("laugh", "happy", "joy", "cheerful", "amused", "giggle"), "✨"),
    (("shock", "gasp", "surprise", "astonish", "startle"), "❗"),
    (("whisper", "quiet", "murmur", "soft"), "🤫"),
    (("shout", "yell", "scream", "roar", "bellow"), "📢"),
]


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_modulo(x: Column, m: int) -> Column:
    """MD5 of the text as a 128-bit number, modulo ``m``, folded in four chunks."""

    def fold(digest: Column) -> Column:
        acc = F.lit(0).cast("long")
        for i in range(4):
            chunk = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
            acc = (acc * (2**32 % m) + chunk) % m
        return acc

    return bind(F.md5(x.cast("binary")), fold)


def speaker_color(name: Column) -> Column:
    hue, sat, light = hash_modulo(name, 360), 65 + hash_modulo(name, 11), 70 + hash_modulo(name, 6)
    made = F.format_string("hsl(%d, %d%%, %d%%)", hue, sat, light)
    return F.when(F.coalesce(name, F.lit("")) == "", "hsl(0, 0%, 70%)").otherwise(made)


def speaker_lane(name: Column) -> Column:
    """Even hashes to the right, odd to the left, no name in the centre."""
    side = F.when(hash_modulo(name, 2) == 0, "right").otherwise("left")
    return F.when(F.coalesce(name, F.lit("")) == "", "center").otherwise(side)


def speaker_class(name: Column) -> Column:
    digits = F.substring(F.regexp_replace(F.md5(name.cast("binary")), "^0+", ""), 1, 16)
    return F.when(F.coalesce(name, F.lit("")) == "", "char-none").otherwise(F.concat(F.lit("char-"), digits))


def tone_emoji(tone: Column) -> Column:
    """Emoji of the first group with a word that the tone contains; empty without one."""
    low, out = F.lower(F.coalesce(tone, F.lit(""))), F.lit("")
    for words, emoji in reversed(TONES):
        out = F.when(low.rlike("|".join(words)), emoji).otherwise(out)
    return out


def hex_rgb(color: Column) -> Column:
    """(r, g, b) of ``#rgb`` or ``#rrggbb``; null else."""
    digits = F.regexp_extract(color, r"^#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})$", 1)
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, r"(.)", "$1$1")).otherwise(digits)
    part = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def hsl_rgb(color: Column) -> Column:
    """(r, g, b) of ``hsl(h, s%, l%)``, rounded half to even; null for other texts."""
    pattern = r"^hsl\(\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)%\s*,\s*(\d+(?:\.\d+)?)%\s*\)$"
    h, s, light = (F.regexp_extract(color, pattern, i).try_cast("double") for i in (1, 2, 3))

    def convert(c: Column) -> Column:
        chroma = (1 - F.abs(2 * c["l"] - 1)) * c["s"]
        k = lambda n: (F.lit(float(n)) + c["h"] / 30) % 12
        channel = lambda n: c["l"] - chroma / 2 * F.greatest(F.lit(-1.0), F.least(k(n) - 3, 9 - k(n), F.lit(1.0)))
        part = lambda n: F.bround(channel(n) * 255).cast("int")
        return F.when(c["h"].isNotNull(), F.struct(part(0).alias("r"), part(8).alias("g"), part(4).alias("b")))

    return bind(F.struct((h % 360).alias("h"), (s / 100).alias("s"), (light / 100).alias("l")), convert)


def luminance(rgb: Column) -> Column:
    """Relative luminance of an (r, g, b) colour."""

    def linear(c: Column) -> Column:
        v = c / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return bind(rgb, lambda c: 0.2126 * linear(c["r"]) + 0.7152 * linear(c["g"]) + 0.0722 * linear(c["b"]))


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, in any order."""
    both = F.struct(luminance(a).alias("x"), luminance(b).alias("y"))
    return bind(both, lambda c: (F.greatest(c["x"], c["y"]) + 0.05) / (F.least(c["x"], c["y"]) + 0.05))


def passes_aa(a: Column, b: Column) -> Column:
    return contrast(a, b) >= 4.5


def rgb_hsl(rgb: Column) -> Column:
    """(h, s, l) of an (r, g, b) colour as whole numbers, halves rounded up."""
    r, g, b = (rgb[c] / 255 for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = top - low, (top + low) / 2
    sat = F.when(span == 0, 0.0).otherwise(span / (1 - F.abs(2 * light - 1)))
    hue = (
        F.when(span == 0, 0.0)
        .when(top == r, ((g - b) / F.nullif(span, F.lit(0.0)) + 6) % 6)
        .when(top == g, (b - r) / F.nullif(span, F.lit(0.0)) + 2)
        .otherwise((r - g) / F.nullif(span, F.lit(0.0)) + 4)
    )
    up = lambda c: F.floor(c + 0.5).cast("int")
    return F.struct(up(hue * 60).alias("h"), up(sat * 100).alias("s"), up(light * 100).alias("l"))


def aspect_fit(width: Column, height: Column, box_width: int = 400, box_height: int = 600) -> Column:
    """Size and offset of an image that is scaled into a box and centred."""
    ratio = F.least(box_width / width, box_height / height)
    w, h = F.floor(width * ratio).cast("int"), F.floor(height * ratio).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((box_width - w) / 2).cast("int").alias("x"), F.floor((box_height - h) / 2).cast("int").alias("y"))


def circle_place(rank: Column, total: Column, radius: float = 1.0) -> Column:
    """Place of the rank-th (from 0) of ``total`` on a circle, from the top."""
    angle = 2 * math.pi * rank / total - math.pi / 2
    return F.struct((radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
