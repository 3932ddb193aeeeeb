"""Base-62 song ids as column expressions: long division of a 256-bit number, limb by limb.

Five limbs take ten divisions. Each pass is bound in a lambda, so the expression stays small wherever the optimizer
copies it to.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from tunefathom.functions.numeric import let

DIGITS = string.digits + string.ascii_letters
ID_LENGTH = 22
#: Bits of a limb, and base-62 digits that one division takes off. A remainder below 62^10 beside a limb has 36 decimal
#: digits and fits a decimal; remainders and the quotient's limbs fit a long.
LIMB_BITS, GROUP = 60, 10
LIMBS = -(-256 // LIMB_BITS)
_FIRST = ord("0")
_NUMBER, _LONG = "decimal(38,0)", "decimal(19,0)"


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def _limbs(digest: Column) -> list[Column]:
    """A number of 64 hexadecimal digits as limbs, highest first."""
    width = LIMB_BITS // 4
    cuts = [(max(0, 64 - width * (i + 1)), 64 - width * i) for i in reversed(range(LIMBS))]
    return [F.conv(F.substring(digest, low + 1, high - low), 16, 10).cast("bigint") for low, high in cuts]


def _divided(limbs: list[Column]) -> tuple[list[Column], Column]:
    """Limbs divided by 62^GROUP: the quotient's limbs but for the highest, which is 0, and the remainder.

    The highest limb is below the divisor: 16 bits at first, and little more after each division, as that takes off
    about one limb.
    """
    base, divisor = F.lit(2**LIMB_BITS).cast(_LONG), F.lit(62**GROUP).cast(_LONG)
    rest, quotient = limbs[0], []
    for limb in limbs[1:]:
        whole = (rest.cast(_LONG) * base + limb.cast(_LONG)).cast(_NUMBER)
        quotient.append(_div(whole, divisor))
        rest = (whole % divisor).cast("bigint")
    return quotient, rest


def _spelt(group: Column) -> Column:
    """The digits of half a group as characters, each ``_FIRST`` above its value."""
    total = F.lit(0).cast("bigint")
    for place in range(GROUP // 2):
        total = total + (_div(group, 62**place) % 62 + _FIRST) * F.lit(256**place)
    return F.unhex(F.hex(total)).cast("string")


def base62(digest: Column, length: int = ID_LENGTH) -> Column:
    """The first ``length`` base-62 digits of a 256-bit number given in hexadecimal, filled up with zeros at the end."""
    half = 62 ** (GROUP // 2)

    def halves(limbs: Column, count: int, found: list[Column]) -> Column:
        """All halves of groups, highest first. A division's results are bound once, as the next one reads them often."""
        if count == 1:
            return F.flatten(F.array(*[F.array(_div(g, half), g % F.lit(half)) for g in (F.get(limbs, F.lit(0)), *reversed(found))]))

        def bound(part: Column) -> Column:
            return halves(part, count - 1, [*found, F.get(part, F.lit(count - 1))])
        quotient, rest = _divided([F.get(limbs, F.lit(i)) for i in range(count)])
        return let(F.array(*quotient, rest), bound)
    spelt = F.transform(let(F.array(*_limbs(digest)), lambda limbs: halves(limbs, LIMBS, [])), _spelt)
    text = F.translate(F.array_join(spelt, ""), "".join(chr(_FIRST + i) for i in range(62)), DIGITS)
    return F.rpad(F.substring(F.ltrim(text, F.lit("0")), 1, length), length, "0")


def song_id(title: Column, artist: Column) -> Column:
    """Stable 22-character key of a title and artist, blind to case and outer spaces."""
    text = F.concat(_trim(F.lower(title)), F.lit("|"), _trim(F.lower(artist)))
    return let(F.sha2(text.cast("binary"), 256), lambda digest: F.when(digest.isNotNull(), base62(digest)))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
