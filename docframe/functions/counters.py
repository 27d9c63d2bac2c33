"""Counter values as text: decimal, roman, alphabetic, bullets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bullets by style; roman digits of units, by place
BULLET_STYLES = {"disc": "•", "circle": "◦", "square": "▪", "none": ""}
ROMAN = ("IVX", "XLC", "CDM", "M")
#: Letters that the greatest long has in bijective base 26.
LETTERS = 14


def roman_digit(digit: int, letters: str) -> str:
    one, five, ten = (letters + "  ")[:3]
    if digit in (4, 9):
        return one + (five if digit == 4 else ten)
    return (five if digit >= 5 else "") + one * (digit % 5)


def roman(value: Column) -> Column:
    """Of 1 to 3999, else null."""
    places = []
    for place in (3, 2, 1, 0):
        digits = F.array(*[F.lit(roman_digit(d, ROMAN[place])) for d in range(4 if place == 3 else 10)])
        places.append(F.element_at(digits, (F.floor(value / 10**place) % 10 + 1).cast("int")))
    return F.when((value >= 1) & (value <= 3999), F.concat(*places))


def alphabetic(value: Column) -> Column:
    """Bijective base 26: 1 is A, 27 is AA; null below 1."""
    n, out = value.cast("long"), F.lit("")
    for k in range(LETTERS):  # the letter k places from the right appears from the number 11...1 (base 26) on
        least = sum(26**i for i in range(k + 1))
        letter = F.char(F.pmod(F.call_function("div", n - F.lit(least), F.lit(26**k)), F.lit(26)) + 65)
        out = F.concat(F.when(n >= least, letter).otherwise(""), out)
    return F.when(value >= 1, out)


def format_counter(value: Column, style: Column) -> Column:
    """Values that a style cannot show, and unknown styles, are decimal."""
    number = value.cast("long").cast("string")
    out = F.when(style.isin(*BULLET_STYLES), F.create_map(*[F.lit(x) for p in BULLET_STYLES.items() for x in p])[style])
    out = out.when(style == "decimal-leading-zero", F.when((value >= 0) & (value < 10), F.concat(F.lit("0"), number)).otherwise(number))
    for names, make in ((("roman",), roman), (("alpha", "latin"), alphabetic)):
        for name in names:
            out = out.when(style == f"upper-{name}", F.coalesce(make(value), number)).when(style == f"lower-{name}", F.lower(F.coalesce(make(value), number)))
    return out.otherwise(number)


def counter_text(value: int, style: str) -> str:
    """As format_counter(), of one value."""
    kind = style.lower().removeprefix("lower-").removeprefix("upper-")
    out = str(value)
    if style in BULLET_STYLES:
        return BULLET_STYLES[style]
    if style == "decimal-leading-zero":
        return f"0{value}" if 0 <= value < 10 else out
    if kind == style:
        return out
    if kind == "roman" and 1 <= value <= 3999:
        out = "".join(roman_digit(value // 10**place % 10, ROMAN[place]) for place in (3, 2, 1, 0))
    elif kind in ("alpha", "latin") and value >= 1:
        out = ""
        while value:
            value, rest = divmod(value - 1, 26)
            out = chr(65 + rest) + out
    return out.lower() if style.startswith("lower-") else out
