"""What a number looks like under a spreadsheet's number format: digits, thousands, scaling, percent, exponents, texts, dates and times."""

from __future__ import annotations

import datetime
import re
from decimal import ROUND_HALF_UP, Decimal

# The standard's format numbers that files don't spell out.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: Texts in quotes, escaped characters, brackets, spaces of a character's width, and fillings.
LITERAL = re.compile(r'"([^"]*)"|\\(.)|\[([^\]]*)\]|_(.)|\*(.)')
DATE_PART = re.compile(r"(?i)\[h+\]|\[m+\]|\[s+\]|y+|m+|d+|h+|s+|\.0+|am/pm|a/p")


def _general(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _sections(code: str) -> list[str]:
    return re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', code)


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", _sections(code)[0], flags=re.I)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and "general" not in bare.lower()


def _literals(section: str) -> tuple[str, list[str]]:
    """The section with each literal as a private character, and what those stand for."""
    texts: list[str] = []

    def keep(m: re.Match) -> str:
        if m[3] is not None:  # [$€-407] shows its symbol, [h] is a part of a time, [Red] shows nothing
            if re.fullmatch(r"(?i)h+|m+|s+", m[3]):
                return m[0]
            texts.append(m[3][1:].split("-")[0] if m[3].startswith("$") else "")
        else:
            texts.append(m[1] if m[1] is not None else m[2] if m[2] is not None else " " if m[4] is not None else "")
        return chr(0xE000 + len(texts) - 1)

    return LITERAL.sub(keep, section), texts


def _restored(text: str, texts: list[str]) -> str:
    return "".join(texts[ord(c) - 0xE000] if 0xE000 <= ord(c) < 0xE000 + len(texts) else c for c in text)


def _date(serial: float, code: str, since_1904: bool) -> str:
    bare, texts = _literals(_sections(code)[0])
    start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
    fine = bool(re.search(r"(?i)s+\.0", bare))
    moment = start + datetime.timedelta(milliseconds=round(serial * 86_400_000) if fine else round(serial * 86_400) * 1000)
    total = round(serial * 86_400)
    half = bool(re.search(r"(?i)am/pm|a/p", bare))
    parts = list(DATE_PART.finditer(bare))
    kinds = [p[0].lower() for p in parts]

    def shown_part(i: int) -> str:
        k, n = kinds[i], len(kinds[i])
        if k[0] == "m" and ((i and kinds[i - 1].lstrip("[")[0] == "h") or (i + 1 < len(kinds) and kinds[i + 1].lstrip("[")[0] == "s")):
            return str(moment.minute).zfill(min(n, 2))
        hour = (moment.hour - 1) % 12 + 1 if half else moment.hour
        if k[0] == "[":
            return str(total // {"h": 3600, "m": 60, "s": 1}[k[1]]).zfill(n - 2)
        if k[0] == ".":
            return "." + f"{moment.microsecond // 1000:03d}"[: n - 1].ljust(n - 1, "0")
        if k in ("am/pm", "a/p"):
            return ("AM" if moment.hour < 12 else "PM")[: 2 if k == "am/pm" else 1]
        return {
            "y": lambda: f"{moment.year:04d}" if n > 2 else f"{moment.year % 100:02d}",
            "m": lambda: str(moment.month).zfill(n) if n < 3 else moment.strftime("%b") if n == 3 else moment.strftime("%B")[:1] if n == 5 else moment.strftime("%B"),
            "d": lambda: str(moment.day).zfill(n) if n < 3 else moment.strftime("%a") if n == 3 else moment.strftime("%A"),
            "h": lambda: str(hour).zfill(min(n, 2)),
            "s": lambda: str(moment.second).zfill(min(n, 2)),
        }[k[0]]()

    out, at = "", 0
    for i, p in enumerate(parts):
        out += bare[at : p.start()] + shown_part(i)
        at = p.end()
    return _restored(out + bare[at:], texts)


def _digits(whole: str, pattern: str) -> str:
    """Whole digits under a pattern of 0, # and commas."""
    least = len(re.sub(r"[^0]", "", pattern))
    whole = whole.lstrip("0").rjust(least, "0")
    return re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", whole) if "," in pattern.strip(",") else whole


def shown(number: float, code: str, since_1904: bool = False) -> str:
    """A number's text under a format; fractions are shown as decimals, and text formats as plain numbers."""
    if is_date(code):
        return _date(number, code, since_1904)
    sections = _sections(code)
    section = sections[0]
    negative = number < 0
    if number < 0 and len(sections) > 1:
        section, negative = sections[1], False
    elif number == 0 and len(sections) > 2:
        section = sections[2]
    bare, texts = _literals(section)
    pattern = re.search(r"[0#?][0#?,]*(?:\.[0#?]*)?,*(?:E[+-][0#?]+)?|\.[0#?]+", bare)
    if re.search(r"(?i)general|@", bare):
        return _restored(re.sub(r"(?i)general|@", ("-" if negative else "") + _general(abs(number)), bare, count=1), texts)
    if pattern is None or "/" in bare:
        return _general(number) if pattern is not None or not bare.strip() else _restored(bare, texts)
    value = Decimal(repr(abs(number))) * 100 ** bare.count("%")
    body, _, power = pattern[0].partition("E")
    value /= 1000 ** (len(body) - len(body.rstrip(",")))
    body = body.rstrip(",")
    whole_pattern, _, fraction_pattern = body.partition(".")
    exponent = 0
    if power and value:
        step = max(1, len(re.sub(r"[^0#?]", "", whole_pattern)))
        exponent = (value.adjusted() // step) * step if step > 1 else value.adjusted()
        value = value.scaleb(-exponent)
    places = len(fraction_pattern)
    text = format(value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP), "f")
    whole, _, fraction = text.partition(".")
    while fraction and fraction[-1] == "0" and fraction_pattern[len(fraction) - 1] != "0":
        fraction = fraction[:-1]
    out = _digits(whole, whole_pattern) + ("." + fraction if "." in body else "")
    if power:
        out += "E" + ("-" if exponent < 0 else "+" if power[0] == "+" else "") + str(abs(exponent)).zfill(len(power) - 1)
    sign = "-" if negative and Decimal(text) != 0 else ""
    return sign + _restored(bare[: pattern.start()] + out + bare[pattern.end() :], texts)
