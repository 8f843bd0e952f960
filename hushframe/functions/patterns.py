"""Detector patterns and their rendering for Java and RE2.

The patterns are written in ECMAScript spelling, where ``\\b`` and ``\\d`` are
ASCII and ``\\s`` is Unicode white space.  ``java_pattern`` and ``re2_pattern``
keep that meaning in the dialects of Spark and of the SQL oracle.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# The detector patterns.
# ---------------------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = (
    r"(?<!\d)(\+?1[\s.\-]?)?(\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4})(?!\d)"
    r"|(\+\d{1,3}[\s.\-]?\(?\d+\)?(?:[\s.\-]?\d{2,}){2,})(?!\d)"
)
PHONE_BY_LANG = {
    "fr": r"(?<!\d)(0[1-9])(?:[\s.\-]?\d{2}){4}(?!\d)",
    "de": r"(?<!\d)0(?:1[5-7]\d[\s\-]?\d{7}|\d{2,5}[\s\-\/]?\d{3,8})(?!\d)",
    "gb": r"(?<!\d)0(?:7\d{3}[\s\-]?\d{6}|\d{3,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4})(?!\d)",
    "es": r"(?<!\d)[6-9]\d{2}[\s.\-]?\d{3}[\s.\-]?\d{3}(?!\d)",
    "it": r"(?<!\d)(?:3\d{2}|0\d{1,3})[\s.\-]?\d{3,4}[\s.\-]?\d{4}(?!\d)",
    "pt": r"(?<!\d)[29]\d{1,2}[\s.\-]?\d{3}[\s.\-]?\d{3,4}(?!\d)",
    "nl": r"(?<!\d)0(?:6[\s\-]?\d{8}|\d{2}[\s\-]?\d{7})(?!\d)",
    "pl": r"(?<!\d)(?:[45]\d{2}|[6789]\d{2}|[12]\d)[\s.\-]?\d{3}[\s.\-]?\d{3,4}(?!\d)",
}
CARD = r"\b(?:\d[ \-]?){13,19}\b"
IBAN = r"\b[A-Z]{2}\d{2}[ A-Z0-9]{10,30}\b"
SSN = r"\b\d{3}[- ]\d{2}[- ]\d{4}\b"
IPV4 = (
    r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
    r"\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
)
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b"
BTC = r"\b(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{39,59})\b"
ETH = r"\b0x[a-fA-F0-9]{40}\b"
SECRET = (
    r"""(?:^|[\s"'`=:])(?:(?:Bearer)\s+\S{8,}"""
    r"|(?:token|password|passwd|secret|api[_-]?key)[=:\s]+\S{4,}"
    r"|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36}|ghs_[A-Za-z0-9]{36}"
    r"|glpat-[A-Za-z0-9\-]{20,}|eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+)"
)
SECRET_LEAD = r"""^["'`=:\s]+"""
DOB = (
    r"\b(?:dob|date of birth|born|birthday)[:\s]+"
    r"(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{4}[\/\-\.]\d{1,2}[\/\-\.]\d{1,2})\b"
)
TOKEN = r"<([A-Z][A-Z0-9_]*)_(\d+)>"
# End of fixed values.

# White space as ECMAScript defines it, as (first, last) code points.
_SPACE_RANGES = (
    (0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    (0xFEFF, 0xFEFF),
)


def _space_class() -> str:
    # \x{..} is understood by Java and by RE2 alike.
    return "".join(
        rf"\x{{{lo:04x}}}" if lo == hi else rf"\x{{{lo:04x}}}-\x{{{hi:04x}}}"
        for lo, hi in _SPACE_RANGES
    )


SPACE = _space_class()

# The same in Java, where other characters fail sooner: its own ``\s`` is the ASCII part,
# and the rest is only looked at beyond ASCII.
_JAVA_SPACE = rf"\s[\x{{0080}}-\x{{ffff}}&&[{SPACE}]]"

# An ASCII word boundary; Java's own \b follows Unicode letters.
_BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def _unicode_space(pattern: str, space: str = SPACE) -> str:
    def put(part: re.Match) -> str:
        group = part.group(0)
        if group.startswith("["):
            return group.replace(r"\s", SPACE if group.startswith("[^") else space)
        return f"[{space}]" if group == r"\s" else f"[^{SPACE}]"

    return re.sub(r"\[[^\]]*\]|\\[sS]", put, pattern)


# Forms that match the same spans but need neither recursion (a repeated group
# recurses once per round in Java) nor repeated scans of one long run.
_JAVA_SAFE = {
    # After two groups the rest of a number is one forced chain of digit runs.
    r"(?:[\s.\-]?\d{2,}){2,}": r"(?:[\s.\-]?\d{2,}){2}(?:[\s.\-]?\d{2,}+)*+",
    # "@" is not in the local part, so giving characters back cannot help.  A
    # start that has an earlier start in the same run fails exactly when that
    # one failed, unless a match has just ended there (\G).
    r"\b[A-Za-z0-9._%+\-]+@": (
        r"(?:\G|(?<!\w)(?<!\w[.%+\-]{1,16}))\b[A-Za-z0-9._%+\-]++@"
    ),
}


def java_pattern(
    pattern: str, ignore_case: bool = False, first: str = "", after: str = "", groups: bool = False
) -> str:
    """Render a pattern above for ``java.util.regex``.

    ``first`` is a class of word characters, or of any characters for a pattern
    without a leading ``\\b``, that every match starts with.  Testing it first lets
    most positions fail at once.
    """
    for plain, safe in _JAVA_SAFE.items():
        pattern = pattern.replace(plain, safe)
    if not groups:
        pattern = re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)
    if first and pattern.startswith(r"\b"):
        pattern = rf"(?={first})(?<!\w){pattern[2:]}"
    elif first:
        behind = f"(?<!{after})" if after else ""
        pattern = rf"(?={first}){behind}(?:{pattern})"
    pattern = _unicode_space(pattern, _JAVA_SPACE).replace(r"\b", _BOUNDARY)
    return ("(?i)" if ignore_case else "") + pattern


def re2_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Render a pattern above (without lookaround) for RE2, as DuckDB uses it."""
    return ("(?i)" if ignore_case else "") + _unicode_space(pattern)
