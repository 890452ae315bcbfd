"""Numbers as people of a language write and read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By language the sign of thousands, the decimal sign and the name of the currency; others are written as the first.
STYLES = {"tr": (".", ",", "TL"), "en": (",", ".", "TRY")}


def _by(lang: Column, place: int) -> Column:
    first, *others = STYLES.items()
    out = F.lit(first[1][place])
    for name, style in others:
        out = F.when(lang == name, style[place]).otherwise(out)
    return out


def _signs(text: Column, lang: Column) -> Column:
    """A number with , for thousands and . for decimals, with the language's signs; one goes by way of a sign that numbers don't have."""
    return F.replace(F.replace(F.replace(text, F.lit(","), F.lit("\x01")), F.lit("."), _by(lang, 1)), F.lit("\x01"), _by(lang, 0))


def _fixed(value: Column, digits: int) -> Column:
    """Rounded half to even, as a decimal; what is rounded to zero has no sign."""
    return F.bround(value.cast("decimal(38,12)"), digits)


def money(value: Column, lang: Column) -> Column:
    """Whole units with the language's sign between thousands, and the currency: 1.234.567 TL, 1,234,567 TRY."""
    return F.concat(_signs(F.format_number(_fixed(value, 0), 0), lang), F.lit(" "), _by(lang, 2))


def percent(value: Column, lang: Column, signed: bool = True) -> Column:
    """A share as per cent with two digits, with its sign even if positive: +1,25%, -0.50%. Thousands aren't parted."""
    x = _fixed(value.cast("decimal(38,16)") * 100, 2)
    text = F.replace(F.format_number(F.abs(x), 2), F.lit(","), F.lit(""))
    sign = F.when(value < 0, "-").otherwise("+") if signed else F.when(value < 0, "-").otherwise("")
    return F.concat(sign, F.replace(text, F.lit("."), _by(lang, 1)), F.lit("%"))


def parsed(text: Column) -> Column:
    """The number that a form's field holds, with a decimal comma or point and spaces around; null where it isn't one."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
