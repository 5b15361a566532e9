"""Numbers to Vietnamese words, as Column expressions on digit strings of any length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let, lit, nth

# The digits and the scale words.
DIGITS = ["không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"]
SCALES = ["", " nghìn", " triệu"]
_SEPARATORS = " -.,"
#: Digits of a number that is still read as one: the scale words of each of its groups grow with its length.
LONGEST = 3_000


def _group(n: int, leading: bool) -> str:
    """A group of three digits; inside a number its hundreds are said even if zero."""
    hundreds, tens, ones = n // 100, n // 10 % 10, n % 10
    said = []
    if hundreds or not leading:
        said.append(f"{DIGITS[hundreds]} trăm")
    if tens == 0 and ones and said:
        said.append("lẻ")
    elif tens == 1:
        said.append("mười")
    elif tens:
        said.append(f"{DIGITS[tens]} mươi")
    if ones == 1 and tens > 1:
        said.append("mốt")
    elif ones == 5 and tens:
        said.append("lăm")
    elif ones:
        said.append(DIGITS[ones])
    return " ".join(said)


_LEADING = [_group(n, True) for n in range(1000)]
_INNER = [_group(n, False) for n in range(1000)]


def stripped(number: Column) -> Column:
    return F.translate(number, _SEPARATORS, "")


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def _whole(digits: Column) -> Column:
    """Digits without leading zeros, not empty."""
    groups = F.ceil(F.length(digits) / 3).cast("int")
    padded = F.lpad(digits, groups * 3, "0")

    def say(k: Column) -> Column:
        value = F.substring(padded, k * 3 + 1, lit(3)).cast("int")
        rank = groups - 1 - k
        words = F.when(k == 0, nth(_LEADING, value)).otherwise(nth(_INNER, value))
        scale = F.concat(nth(["-", *SCALES[1:]], rank % 3), F.repeat(lit(" tỷ"), F.floor(rank / 3).cast("int")))
        return F.when(value > 0, F.concat(words, F.when(rank % 3 == 0, F.repeat(lit(" tỷ"), F.floor(rank / 3).cast("int"))).otherwise(scale)))

    many = F.array_join(F.transform(F.sequence(lit(0), groups - 1), say), " ")  # null groups are left out
    return F.when(F.length(digits) <= 3, nth(_LEADING, digits.cast("int"))).otherwise(many)


def n2w(number: Column) -> Column:
    """Whole numbers; ``0d`` keeps its zero, what isn't a number stays as it is."""
    digits = stripped(number)
    bare = F.regexp_replace(digits, "^0+", "")
    two = digits.rlike("^0[0-9]$")
    return (
        F.when(~is_digits(digits), number)
        .when(two, F.concat(lit(f"{DIGITS[0]} "), nth(DIGITS, F.substring(digits, 2, 1).cast("int"))))
        .when(bare == "", lit(DIGITS[0]))
        .when(F.length(bare) > LONGEST, each_digit(digits))
        .otherwise(_whole(bare))
    )


def each_digit(digits: Column) -> Column:
    """Digit by digit."""
    out = digits
    for k, word in enumerate(DIGITS):
        out = F.replace(out, lit(str(k)), lit(f"{word} "))
    return F.rtrim(out)


def n2w_single(number: Column) -> Column:
    """A telephone number or code, digit by digit; +84 is read as 0."""
    local = F.regexp_replace(number, r"^\+84", "0")
    digits = stripped(local)
    return F.when(is_digits(digits), each_digit(digits)).otherwise(local)


def n2w_decimal(digits: Column) -> Column:
    """Decimals digit by digit; a last 5 after another digit than 0 is "lăm"."""
    clean = stripped(digits)
    return F.when(clean.rlike("[1-9]5$"), F.concat(each_digit(F.regexp_replace(clean, "5$", "")), lit(" lăm"))).when(clean == "", digits).otherwise(each_digit(clean))


def several(numbers: list[Column], say: Callable[..., Column]) -> Column:
    """``say`` of the words of whole numbers. The expression for words is large, so it stands once for all of them."""
    return let(F.transform(F.array(*numbers), n2w), lambda words: say(*(F.get(words, lit(k)) for k in range(len(numbers)))))


def _pointed(whole: Column, decimals: Column, point: Column) -> Column:
    """A whole number, and decimals if there are any."""
    return F.concat(let(whole, n2w), let(decimals, lambda d: F.when(F.coalesce(d, lit("")) == "", lit("")).otherwise(F.concat(point, n2w_decimal(d)))))


def _part(text: Column, mark: str, k: int) -> Column:
    return F.get(F.split(text, f"\\{mark}", -1), lit(k))


def quantity(number: Column) -> Column:
    """A number before a unit, currency or percent sign: with one kind of mark, these are for thousands if there are several or three digits follow one."""
    comma, dot = number.contains(","), number.contains(".")
    plain = lambda mark: F.replace(number, lit(mark), lit(""))
    thousands = lambda mark: (F.length(number) - F.length(plain(mark)) > 1) | (F.length(_part(number, mark, 1)) == 3)
    dot_last = number.rlike(r"\.[^,]*$")
    parts = (
        F.when(comma & dot, F.when(dot_last, F.split(plain(","), r"\.", -1)).otherwise(F.split(plain("."), ",", -1)))
        .when(comma, F.when(thousands(","), F.array(plain(","))).otherwise(F.split(number, ",", -1)))
        .when(dot, F.when(thousands("."), F.array(plain("."))).otherwise(F.split(number, r"\.", -1)))
        .otherwise(F.array(number))
    )
    return let(parts, lambda p: _pointed(F.get(p, lit(0)), F.rtrim(F.get(p, lit(1)), lit("0")), F.when(dot & ~comma, " chấm ").otherwise(" phẩy ")))


def power(exponent: Column) -> Column:
    sign = F.regexp_extract(exponent, "^([-+]?)", 1)
    digits = n2w(F.regexp_replace(exponent, r"^[-+]", ""))
    return F.when(sign == "-", F.concat(lit("trừ "), digits)).otherwise(digits)


def scientific(base: Column, exponent: Column) -> Column:
    """3.2e5: the base with its point, then the power of ten."""
    dot = base.contains(".")
    parts = F.when(dot, F.split(base, r"\.", -1)).otherwise(F.split(base, ",", -1))
    said = let(parts, lambda p: _pointed(F.get(p, lit(0)), F.rtrim(F.get(p, lit(1)), lit("0")), F.when(dot, " chấm ").otherwise(" phẩy ")))
    return F.concat(said, lit(" nhân mười mũ "), power(exponent))


def plain_number(number: Column, negative: Column) -> Column:
    """A number in running text; zeros at its end are said."""
    sign = F.when(negative, lit("âm ")).otherwise(lit(""))
    grouped = number.rlike(r"^[0-9]+(\.[0-9]{3})+$")
    tight = F.replace(number, lit(" "), lit(""))
    whole = F.when(grouped, F.replace(tight, lit("."), lit(""))).otherwise(tight)
    dot = number.contains(".") & ~grouped
    parts = F.when(dot, F.split(tight, r"\.", -1)).otherwise(F.split(whole, ",", -1))
    return F.concat(sign, let(parts, lambda p: _pointed(F.get(p, lit(0)), F.get(p, lit(1)), F.when(dot, " chấm ").otherwise(" phẩy "))))
