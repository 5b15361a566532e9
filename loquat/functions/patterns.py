"""The patterns of the written forms.

What they match is part of the results. Digits are ASCII digits, as texts bring all others to these first.

Patterns take time in proportion to the text, whatever it holds, and no stack. Java's engine recurses for each turn of a
group that repeats, unless the group is possessive; and a search that fails is begun anew at each place. So groups that
repeat keep what they have (``*+``; what follows can't begin with what they take), and where a search can fail after a long
run, it begins at the run's first place only (``_first``, ``_chain``, a look behind). The end of the match before
(``\\G``) is such a place too.
"""

from __future__ import annotations

import re

from . import resources as R

U = "(?U)"  # classes and word ends of Unicode
I = "(?iU)"  # noqa: E741  and no case

# Most characters of a text are plain letters that begin no match. Where a pattern's first test is a dear one (a word end, a
# look behind, a class without case), a look at the one character comes before it, which says no more than what follows.
_AT_DIGIT = "(?-i:(?=[0-9]))"
_NUMBER = r"([0-9]++(?:[.,][0-9]++)*+)"
_NEW_NUMBER = rf"{_AT_DIGIT}(?<![0-9])(?<![0-9][.,])"
_MAGNITUDE = rf"(?:\s*({'|'.join(R.MAGNITUDES)}))?"
_DASH = r"[–\-—]"
_ONE_POINT = r"([0-9]+(?:[.,][0-9]+)?)"
_BOUNDED = r"([0-9]{1,15}(?:[,.][0-9]{1,15})?)"
_WEB = r"[A-Za-z0-9.\-_~:/?#\[\]@!$&'()*+,;=]"
_SUFFIX = "|".join(R.SUFFIXES)


def _any(keys) -> str:
    return "|".join(re.sub(r"([.\\^$|?*+()\[\]{}])", r"\\\1", k) for k in keys)


def _singles_of(pairs) -> str:
    """What stands in a class for the first characters of the keys."""
    return "".join(rf"\x{{{ord(c):X}}}" for c in sorted({k[0] for k, _ in pairs}))


def literals(keys, fold: bool = False) -> str:
    """A pattern for any of the keys, the longest that fits first: their trie, so that each character is looked at once.

    With ``fold`` (for patterns without case) keys that differ in case only are one.
    """
    trie: dict = {}
    for key in sorted({k.lower() if fold else k for k in keys}):
        at = trie
        for c in key:
            at = at.setdefault(c, {})
        at[""] = {}

    def said(at: dict) -> str:
        ways = [_any([c]) + said(at[c]) for c in at if c]
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 and ("" not in at or len(ways[0]) == 1) else f"(?:{'|'.join(ways)})"
        return f"{one}?" if "" in at else one

    return said(trie)


def _first(word: str, marks: str) -> str:
    """The first word boundary of a run of these characters: the run's begin, or the end or begin of the word it begins with."""
    run = word + marks
    # what is cheap to see comes first: the looks behind take some thousand steps, and are for boundaries inside a run only
    return rf"\b(?=[{run}])(?:\G|(?<![{run}])|(?<=[\w&&[^{run}]][{word}]{{1,60}})|(?<=(?:^|[^\w{run}])[{marks}]{{1,60}}))"


# A number of a chain like 1.2,3 that begins where the chain does, or behind a name such as a1 in a1.2
_CHAIN = r"(?:\G|(?<![0-9][.,])|(?<=[^\W0-9][0-9]{1,30}[.,]))"
_UNITS = literals([*R.UNITS, *R.CURRENCIES], fold=True)
_EXCEPTIONS = literals({**R.ACRONYMS, **R.TERMS})
# Letters and digits, and more of them behind low lines, dots or hyphens; a word ends with each part that is counted.
_AN = "[a-zA-Z0-9]++"
_PART = rf"[.\-]{_AN}(?:_{_AN})*+\b"

# Addresses, paths and names, and what they are split at. A dot whose next word is a suffix takes the
# marks between them along.
# All but a path begin at a word end, with letters and digits (or none) up to the first mark; so plain words are passed there.
_SLASH = r"(?=/)(?<!\w)(?:\G|(?<!/[._\-]{0,60})|(?<=\w/[._\-]{0,60}))/[a-zA-Z0-9._\-/]{2,}\b"
_FOLDED = r"\x{130}\x{131}\x{17F}\x{212A}"  # letters that are a to z when case doesn't count
TECHNICAL = I + rf"(?-i:(?=[a-zA-Z0-9._\-/{_FOLDED}]))(?:{_SLASH}|(?-i:(?![a-zA-Z0-9_])|(?<![a-zA-Z0-9_]))\b(?-i:(?=[a-zA-Z0-9{_FOLDED}]*+[._:\-]))(?:" + "|".join(
    (
        rf"\b(?:https?|ftp)://{_WEB}+\b",
        rf"\b(?:www\.){_WEB}+\b",
        _first("A-Za-z0-9", r".\-") + rf"[A-Za-z0-9.\-]+(?:\.com|\.vn|\.net|\.org|\.gov|\.io|\.biz|\.info)(?:/{_WEB}*)?\b",
        r"\b[a-zA-Z]:\\[a-zA-Z0-9._\\\-]+\b",
        _first("A-Za-z0-9_", r".\-") + rf"[a-zA-Z0-9._\-]+\.{literals(R.FILES, fold=True)}\b",
        # at least two parts more, however they are split between low lines and other marks
        rf"\b[a-zA-Z][a-zA-Z0-9]*+(?:(?:_{_AN}){{2,}}+\b(?:{_PART})*+|_{_AN}\b(?:{_PART})++|[.\-]{_AN}(?:_{_AN})++\b(?:{_PART})*+|(?:{_PART}){{2,}}+)",
        r"\b(?:[a-fA-F0-9]{1,4}:){3,7}[a-fA-F0-9]{1,4}\b",
    )
) + "))"
# Group 1 is what the run has before its first word boundary, which is passed from the run's begin on, without a look
# behind at each character; group 2 is the address.
EMAIL = U + r"((?:\G|(?<![A-Za-z0-9._%+\-]))(?>\b|[A-Za-z0-9_]++\b|[.%+\-]++\b))([A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b)"
TECHNICAL_PARTS = rf"(?i)(?<!\.[./:?&=_ \\-]{{0,60}})\.[./:?&=_ \\-]*(?:{_SUFFIX})(?=[./:?&=_ \\#-]|$)|[./:?&=_ \\#-]|[^./:?&=_ \\#-]+"
USER_PARTS = r"[._+-]|[^._+-]+"
HOST_PARTS = rf"(?i)(?<!\.[._+-]{{0,60}})\.[._+-]*(?:{_SUFFIX})(?=[._+-]|$)|[._+-]|[^._+-]+"
_SPAN = r"<en>(?:[^<\n]++|<(?!/en>))*+"
TAGS = rf"(?iUd){_SPAN}(?:</en>)?+"  # one that isn't closed goes to the end of the line
CLOSED = r"(?is)</en>$"
INNER_TAGS = rf"(?iUd){R.EN}.*?{R.END}|{_SPAN}</en>"
# Letters of an old script (small, and with no other case) that stand for what is kept out of the text, and one for themselves.
JOINTS = ENGLISH, MAIL, NAME, TAG = "\u2c30\u2c31\u2c32\u2c33"
SPARE = "\u2c34"

# Powers, differences and telephone numbers.
EXPLICIT_POWER = I + _AT_DIGIT + rf"\b{_ONE_POINT}\s*[x*×]\s*10\^([-+]?[0-9]+)\b"
MINUS_AFTER_WORD = I + rf"\b(bằng|tính|kết quả)\s+{_ONE_POINT}\s*[-–—]\s*{_ONE_POINT}\b"
MINUS_BEFORE_WORD = I + _AT_DIGIT + rf"\b{_ONE_POINT}\s*[-–—]\s*{_ONE_POINT}\s+(bằng|tính|kết quả)\b"
RANGE_AFTER_WORD = I + rf"\b(từ|khoảng|trong)\s+{_ONE_POINT}\s*[-–—]\s*{_ONE_POINT}\b"
DASHED_PHONE = U + _AT_DIGIT + rf"\b(0[0-9]{{2,3}}){_DASH}([0-9]{{3,4}}){_DASH}([0-9]{{4}})\b"
IMPLICIT_POWER = U + _AT_DIGIT + r"\b10\^([-+]?[0-9]+)\b"
PHONE = r"(?=[+08])(?:\+84|84|0|0084)[35789][0-9]{8}"

# Dates and times.
FULL_DATE = I + _AT_DIGIT + r"\b([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{4})\b"
MONTH_YEAR = I + _AT_DIGIT + r"\b([0-9]{1,2})[/\-.]([0-9]{4})\b"
DAY_MONTH = I + _AT_DIGIT + r"\b([0-9]{1,2})[/-]([0-9]{1,2})\b"
DOUBLE_WORDS = [(rf"{I}\b{word}\s+{word}\b", word) for word in ("ngày", "tháng", "năm")]
FULL_TIME = I + _AT_DIGIT + r"\b([0-9]+)[g:h]([0-9]{1,2})[p:m]([0-9]{1,2})(?:\s*(?:giây|s|g))?\b"
CLOCK_TIME = I + _AT_DIGIT + r"\b([0-9]+)([g:h])([0-9]{1,2})(?:\s*(?:phút|p|m))?\b"
HOUR_OF_DAY = I + _AT_DIGIT + r"\b([0-9]+)g\s*(sáng|trưa|chiều|tối|khuya)\b"
HOUR_AT = I + r"\blúc\s*([0-9]+)g\b"

# Ranges, arrows, units, currencies and percentages.
NUMBER_RANGE = U + _AT_DIGIT + rf"(?<![0-9.,]){_BOUNDED}(\s*){_DASH}(\s*){_BOUNDED}(?![0-9.,])"
SPACED_DASH = U + rf"(?<=\s){_DASH}(?=\s)"
ARROW = U + r"(?:(?<!\s)\s++|)(?:->|=>)\s*+"
SCIENTIFIC = I + _AT_DIGIT + rf"\b{_ONE_POINT}e([+-]?[0-9]+)\b"
COMPOUND_UNIT = I + rf"\b(?:{_CHAIN}{_NUMBER})?\s*([a-zμµ²³°]+)/([a-zμµ²³°0-9]+)\b"
MEASURED = I + _AT_DIGIT + rf"(?<![0-9.,]){_NUMBER}{_MAGNITUDE}\s*({_UNITS})\b"
BARE_UNIT = I + rf"(?-i:(?=[kKcCmMuUvVpP\x{{212A}}])(?<![0-9.,a-zA-Z]))\b({'|'.join(R.BARE_UNITS)})\b"
PREFIX_CURRENCY = I + rf"([$€¥£₩])\s*{_NUMBER}{_MAGNITUDE}"
SUFFIX_CURRENCY = I + rf"{_NEW_NUMBER}{_NUMBER}{_MAGNITUDE}([$€¥£₩])"
PERCENT = I + rf"{_NEW_NUMBER}{_NUMBER}\s*%"

# Ways to write a number.
ENGLISH_NUMBER = U + _AT_DIGIT + r"\b[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\b"
MANY_COMMAS = U + _AT_DIGIT + r"\b([0-9]++(?:,[0-9]++\b){2,}+)"
COMMA_NUMBER = U + _AT_DIGIT + r"(?<![0-9.])([0-9]+(?:\.[0-9]{3})*),([0-9]+)(%)?"
DOTTED_THOUSANDS = U + _AT_DIGIT + r"(?<![0-9.])[0-9]+(?:\.[0-9]{3})+(?![0-9.])"
SLASHES = U + _AT_DIGIT + r"\b([0-9]+)/([0-9]+)\b"
DIGITS_LETTER = U + _AT_DIGIT + r"\b([0-9]+)([a-zA-Z])\b"
VERSION = U + _AT_DIGIT + r"(?<![-–—])\b([0-9]++(?:\.[0-9]++\b){2,}+)"
COLON_NUMBERS = U + _AT_DIGIT + r"\b([0-9]+):([0-9]+)\b"
ORDINAL = I + r"(thứ|hạng)(\s+)([0-9]+)\b"
PRODUCT = U + _AT_DIGIT + r"([0-9]{1,15})(?:x|\sx\s)([0-9]{1,15})"
NUMBER = U + r"(?=[-–—0-9])(?<![0-9])(?:(?<![^\s(\[;,.])([-–—])|([-–—]))?([0-9]+(?:,[0-9]+|(?:\.[0-9]{3})+(?![0-9])|\.[0-9]+|(?:\s[0-9]{3})+(?![0-9]))?)(?![0-9])"
INNER_DOT = U + r"(?<=[0-9])\.(?=[0-9])"

# Acronyms, letters, symbols and brackets.
EXCEPTION = U + rf"(?=[{_singles_of((k, '') for k in {**R.ACRONYMS, **R.TERMS})}])\b(?:{_EXCEPTIONS})\b"
SUFFIX = I + rf"\.({_SUFFIX})\b"
ROMAN = U + r"(?=[IVXLCDM])\b(?=[IVXLCDM]{2,})(M{0,4})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})(?<=[IVXLCDM])\b"
LETTER_NAME = I + r"(chữ|chữ cái|kí tự|ký tự)\s+['\"]?([a-z])['\"]?\b"
PRIME = U + r"(\b[a-zA-Z0-9])['’](?!\w)"
UNIT_POWER = U + r"\b([a-zA-Z]+)\^([-+]?[0-9]+)\b"
DOUBLE_QUOTE = '(?![a-zA-Z ])["“”]'
SYMBOL = f"(?![a-zA-Z .,\\n])(?=[{_singles_of(R.SYMBOLS)}]){literals(k for k, _ in R.SYMBOLS)}"
QUOTE = U + r"(^|\s)['’]++|(?<!['’])['’]++($|\s)"
# What brackets hold, in one line, and the bracket that closes it. An open bracket without one is taken with the rest of
# its line, up to an open bracket at the line's end.
BRACKETS = U + r"(?d)[(\[{](?:\s*+((?:[^)\]}\s]++(?:[\s&&[^\n]]++(?=[^)\]}\s]))?+)*+)\s*+([)\]}])|(?:[^)\]}\n(\[{]|[(\[{](?![\s&&[^\n]]*+\n))*+)"
BRACKET = r"[\[\](){}]"
DEGREES = [(rf"{I}{sign or '(?<![0-9])'}([0-9]+(?:[.,][0-9]+)?)\s*°\s*{letter}\b", f"{said}$1 độ {scale}") for sign, said in (("-", "âm "), ("", "")) for letter, scale in (("c", "xê"), ("f", "ép"))]
SENTENCE_END = U + r"(?<![.!?])[.!?]++(?:\s++|$)"
ACRONYM = U + r"(?=[A-Z0-9])\b(?=[A-Z0-9]*[A-Z])[A-Z0-9]{2,}\b"
# what is known of ASCII is passed over before the long list is looked through
UNKNOWN = U + rf"(?![a-zA-Z ])(?![\x09-\x0D0-9.,!?_'-])[^a-zA-Z0-9\s{R.VIETNAMESE}{R.VIETNAMESE.upper()}{JOINTS}.,!?_'’-]"
SINGLE_LETTER = U + r"(?<![a-zA-Z])(?=[a-zA-Z](?![a-zA-Z]))(?<!['’])\b([a-zA-Z])\b(\.?)"

# Blanks and commas.
BLANKS = r"[\t\xA0][ \t\xA0]*+| [ \t\xA0]++"  # a run of them, but for one blank alone, which stays as it is
OUTER_BLANKS = U + r"(?![!-~])(?:^\s++|(?<!\s)\s++$)"
DOUBLE_COMMA = U + r",\s*,"
COMMA_BEFORE_STOP = U + r",\s*([.!?;])"
BLANK_BEFORE_MARK = U + r"(?![!-~])(?<!\s)\s++([,.!?;:])"
MARK_BEFORE_TEXT = U + r"([.,!?;:])(?=[^\s0-9<])"
