"""Stand-ins for speech models, and WAV clips, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spoken(text: Column) -> Column:
    """The clip of a stand-in voice: the text's own bytes, which ``heard`` gives back."""
    return text.cast("binary")


def heard(clip: Column) -> Column:
    """What a stand-in recogniser hears in such a clip: the text, bytes that are none replaced."""
    return F.make_valid_utf8(clip.cast("string"))


def _little(n: Column, size: int) -> Column:
    """A number's bytes, lowest first, as hexadecimal digits."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def silence(samples: Column, rate: int = 16_000) -> Column:
    """A WAV clip of so many silent samples: one channel, 16 bits."""
    size = samples.cast("long") * 2
    text = lambda t: F.lit(t.encode().hex())
    head = F.concat(
        text("RIFF"), _little(size + 36, 4), text("WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(1), 2), _little(F.lit(rate), 4), _little(F.lit(2 * rate), 4), _little(F.lit(2), 2), _little(F.lit(16), 2), text("data"), _little(size, 4)
    )
    return F.unhex(F.concat(head, F.repeat(F.lit("00"), size.cast("int"))))
