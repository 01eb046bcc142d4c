"""Currencies and scales named in words and symbols around a figure."""

from __future__ import annotations

import re

# Spellings of currencies and scales.
CURRENCIES = {
    "USD": ["US$", "USD", "$", "US dollars", "US dollar", "U.S. dollars", "dollars", "dollar"],
    "EUR": ["EUR", "€", "euros", "euro"],
    "GBP": ["GBP", "£", "pounds sterling", "pound sterling", "pounds"],
    "JPY": ["JPY", "¥", "yen"],
    "INR": ["INR", "₹", "Rs.", "Rs", "rupees", "rupee"],
    "CHF": ["CHF", "Swiss francs", "Swiss franc", "francs"],
}
SCALES = {
    1.0: ["whole", "not rounded", "units"],
    1e3: ["thousands", "thousand", "thsd.", "thsd", "'000s", "'000", "’000", "000s", "k", "K"],
    1e5: ["lakhs", "lakh"],
    1e6: ["millions", "million", "mn", "Mn", "MM", "mm", "Mio.", "Mio", "mio.", "M", "m"],
    1e7: ["crores", "crore", "Crores", "Crore", "Cr.", "Cr", "cr"],
    1e9: ["billions", "billion", "bn", "Bn", "BN", "Mrd.", "Mrd", "B", "b"],
    1e12: ["trillions", "trillion", "tn", "Tn"],
}
_CURRENCY = {s.lower(): c for c, names in CURRENCIES.items() for s in names}
_SCALE = {s: f for f, names in SCALES.items() for s in names} | {
    s.lower(): f for f, names in SCALES.items() for s in names if len(s) > 2
}


def _any(names: list[str]) -> str:
    return "(?:" + "|".join(re.escape(x) for x in sorted(set(names), key=len, reverse=True)) + ")"


_CUR = "(?i:" + _any(list(_CURRENCY)) + ")"
_SCL = "(?:" + _any(list(_SCALE)) + "|(?i:" + _any([s for s in _SCALE if len(s) > 2]) + "))"
_END = r"(?![\w$€£¥₹])"
NUMBER = re.compile(r"(?<![\w.,])[-−(]?\d[\d,]*(?:\.\d+)?(?![\d])")
_BEFORE = re.compile(rf"(?<![A-Za-z])({_CUR})\s*$")
_AFTER = re.compile(rf"^\s*(?:({_SCL}){_END}(?:\s*(?:of\s+)?({_CUR}){_END})?|({_CUR}){_END}(?:\s*({_SCL}){_END})?)")
_UNIT = re.compile(rf"^\W*?(?:({_CUR})\W*?({_SCL})?|({_SCL})\W*?(?:of\s+)?({_CUR})?)[\s.,;:)\]]*$")
_GENERAL = [
    re.compile(rf"(?<![\w])({_SCL})\s+(?:of\s+)?({_CUR}){_END}"),
    re.compile(rf"(?<![\w$€£¥₹])({_CUR})\s*,?\s*({_SCL}){_END}"),
]
_GENERAL_CURRENCY = re.compile(rf"(?i:\b(?:in|of|currency)\b:?\s+)({_CUR}){_END}|[\[(]\s*({_CUR})\s*[\])]")
_GENERAL_SCALE = re.compile(rf"(?i:\bin\s+)((?i:{_any([s for s in _SCALE if len(s) > 3])})){_END}")
REFERENCE_NOTE = re.compile(r"(?i)\breference (?:values?|figures?|amounts?)\b[^.]*?\b(?:in|as)\b\s*([^.]*(?:\.(?!\s|$)[^.]*)*)\.?")
REVENUE_WORD = re.compile(r"(?i)\b(?:revenues?|sales|turnover)\b")

Unit = tuple[str | None, float | None]


def _currency(s: str | None) -> str | None:
    return _CURRENCY.get(s.lower()) if s else None


def _scale(s: str | None) -> float | None:
    if not s:
        return None
    return _SCALE.get(s, _SCALE.get(s.lower()) if len(s) > 2 else None)


def parse_unit(text: str | None) -> Unit:
    """Currency and scale of a unit given alone, as "USD million", "$m" or "crores of rupees"; (None, None) for another word."""
    m = _UNIT.match(text.strip()) if text and text.strip() else None
    if not m:
        return None, None
    return _currency(m[1] or m[4]), _scale(m[2] or m[3])


def _first(a: Unit, b: Unit) -> Unit:
    return a[0] or b[0], a[1] or b[1]


def find_figure(text: str, value: float | None) -> tuple[int, int] | None:
    """Span of the number that is the value, else of the first number behind a word for revenue."""
    spans = [m.span() for m in NUMBER.finditer(text)]
    if value is not None:
        for s, e in spans:
            try:
                if abs(float(text[s:e].strip("(-−").replace(",", "")) - abs(value)) <= 1e-9 * abs(value):
                    return s, e
            except ValueError:
                pass
    for word in REVENUE_WORD.finditer(text):
        for s, e in spans:
            if s >= word.end() and s - word.end() < 60 and text[e : e + 1] != "%" and not text[word.end() : s].count("."):
                return s, e
    return None


def unit_at(text: str, span: tuple[int, int]) -> tuple[Unit, int, int]:
    """The unit right at a figure, and the stretch that names it."""
    s, e = span
    before = _BEFORE.search(text[max(0, s - 20) : s])
    after = _AFTER.match(text[e : e + 40])
    currency = _currency(before[1]) if before else None
    scale = None
    if after:
        scale = _scale(after[1] or after[4])
        currency = currency or _currency(after[2] or after[3])
    return (currency, scale), s - (len(before[0]) if before else 0), e + (after.end() if after else 0)


def general_unit(text: str) -> Unit:
    """The unit that a text names for its figures in general."""
    for i, p in enumerate(_GENERAL):
        if m := p.search(text):
            return (_currency(m[2]), _scale(m[1])) if i == 0 else (_currency(m[1]), _scale(m[2]))
    c, s = _GENERAL_CURRENCY.search(text), _GENERAL_SCALE.search(text)
    return _currency(c[1] or c[2]) if c else None, _scale(s[1]) if s else None


def unit_of(value: float | None, text: str | None, named: str | None = None) -> Unit:
    """Unit of an amount: what ``named`` says, then what stands right at the figure in the text, then the general one."""
    unit = parse_unit(named)
    if not text or (unit[0] and unit[1]):
        return unit
    text = REFERENCE_NOTE.sub(" ", text)
    span = find_figure(text, value)
    if span:
        own, s, e = unit_at(text, span)
        unit = _first(unit, own)
        text = text[:s] + " # " + text[e:]
    return _first(unit, general_unit(text))


def reference_unit_of(value: float | None, text: str | None, named: str | None) -> Unit:
    """Unit of a reference amount: the one named, else the note on reference values in the text, else as for other amounts."""
    if named and named.strip():
        return parse_unit(named)
    m = REFERENCE_NOTE.search(text or "")
    if m:
        unit = parse_unit(m[1])
        return unit if unit != (None, None) else general_unit("in " + m[1])
    return unit_of(value, text)
