"""Which characters look alike: tables built by rule from the Unicode database.

``plain_char`` gives the plain spelling of one code point. The only listed values are
the letters of other scripts that imitate a Latin letter; everything else follows
from Unicode properties, so the tables grow with the Unicode version in use.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts and the Latin letter each looks like.
IMITATORS = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q",
    "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ԍ": "G",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y", "к": "k",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "ω": "w",
    # Armenian
    "Օ": "O", "Ս": "U", "Լ": "L", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q",
    # Latin letters that imitate a plain one
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K",
    "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

#: Kinds of compatibility decomposition whose result looks like the character itself.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Characters of category Cf that do show on the page.
SHOWN_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Letters and marks without ink that are not of category Cf.
BLANK_LETTERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}
LINE_CONTROLS = {*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85}


def is_invisible(cp: int) -> bool:
    """True for a code point that leaves no mark and no gap on the page."""
    kind = unicodedata.category(chr(cp))
    return (
        (kind == "Cf" and cp not in SHOWN_FORMATS)
        or (kind == "Cc" and cp not in LINE_CONTROLS)
        or cp in BLANK_LETTERS
        or 0xFE00 <= cp <= 0xFE0F
        or 0x180B <= cp <= 0x180F
        or 0xE0100 <= cp <= 0xE01EF
    )


def _letter_block(cp: int) -> bool:
    # Roman numerals and Latin ligatures are drawn as the letters they stand for.
    return 0x2160 <= cp <= 0x217F or 0xFB00 <= cp <= 0xFB06 or cp in (0x212A, 0x212B)


def plain_char(cp: int) -> tuple[int, ...]:
    """Plain spelling of one code point, fully decomposed; () if it is invisible."""
    if is_invisible(cp):
        return ()
    ch = chr(cp)
    if unicodedata.category(ch) == "Zs":
        return (0x20,)
    if 0xAC00 <= cp <= 0xD7A3:
        return tuple(map(ord, unicodedata.normalize("NFD", ch)))
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0].startswith("<"):
        parts = parts[1:] if parts[0] in SAME_LOOK or _letter_block(cp) else []
    if parts:
        return tuple(p for x in parts for p in plain_char(int(x, 16)))
    return (ord(IMITATORS.get(ch, ch)),)


@lru_cache(maxsize=None)
def changed_chars() -> dict[int, tuple[int, ...]]:
    """Code points whose plain spelling after recomposition is another string."""
    out = {}
    for cp in range(sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        to = plain_char(cp)
        if unicodedata.normalize("NFC", "".join(map(chr, to))) != chr(cp):
            out[cp] = to
    return out


@lru_cache(maxsize=None)
def tables() -> dict:
    """``split``: decompositions needed inside a run of unstable characters; ``pairs``:
    two code points that compose; ``marks``: combining class; ``unstable``: code points
    that cannot be copied without looking at their neighbours."""
    pairs, split = {}, dict(changed_chars())
    marks = {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        if c := unicodedata.combining(ch):
            marks[cp] = c
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<"):
            parts = [int(x, 16) for x in d.split()]
            if len(parts) == 2 and unicodedata.normalize("NFC", chr(parts[0]) + chr(parts[1])) == ch:
                pairs[tuple(parts)] = cp
            full = plain_char(cp)
            if full != (cp,):
                split.setdefault(cp, full)
    second = {b for _, b in pairs}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    unstable = set(changed_chars()) | set(marks) | second | jamo
    return {"split": split, "pairs": pairs, "marks": marks, "unstable": unstable}


def ranges(cps: set[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for cp in sorted(cps):
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(a, b) for a, b in out]


#: Blocks most text is written in, the commonest first.
COMMON_BLOCKS = [(0x20, 0x7E), (0xAC00, 0xD7A3), (0x09, 0x0D), (0x4E00, 0x9FFF), (0xB0, 0xFF), (0x3001, 0x301F), (0x3041, 0x3096), (0x30A1, 0x30FA)]


@lru_cache(maxsize=None)
def java_common() -> str:
    """Common stable characters as the inside of a Java character class.

    A class of all unstable characters has some 400 ranges, which Java tries one by one;
    these few ranges are the stable part of the common blocks. A stable character
    outside of them is merely looked at and comes back as it was.
    """
    unstable, out = tables()["unstable"], []
    for lo, hi in COMMON_BLOCKS:
        out += ranges({cp for cp in range(lo, hi + 1) if cp not in unstable})
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


@lru_cache(maxsize=None)
def _python_tools():
    table = {cp: "".join(map(chr, to)) for cp, to in tables()["split"].items()}
    table |= {cp: "".join(map(chr, to)) for cp, to in changed_chars().items()}
    body = "".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in ranges(tables()["unstable"]))
    return table, re.compile(f"[{body}]")


def plain_text(text: str | None) -> str | None:
    """Plain form of one text (used on Arrow batches, where a whole column is at hand)."""
    if text is None:
        return None
    table, odd = _python_tools()
    if text.isascii() and not odd.search(text):
        return text
    if not odd.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table))


_NOT_BARE = re.compile(r"[\W_]+")


def bare_text(text: str | None) -> str | None:
    """Plain form in lower case, letters and digits only."""
    return None if text is None else _NOT_BARE.sub("", plain_text(text).lower())


_STORED = re.compile(r"(?is)\s*instruct\s*:.*?[\r\n]\s*query\s*:|\s*instruct\s*:.*query\s*:")


def bare_body(query: str | None) -> str | None:
    """Bare form of a query without its stored instruction (``Instruct: …``, new line,
    ``Query: …``), which is looked for in plain form, in any letter case."""
    if query is None:
        return None
    text = plain_text(query)
    if m := _STORED.match(text):
        text = text[m.end() :]
    return _NOT_BARE.sub("", text.lower())


#: In ``bare_codes``: the text that holds this code point is worked on by itself.
_ALONE = 0xFFFFFFFF


@lru_cache(maxsize=None)
def bare_codes():
    """For every code point its bare form as one code point, 0 if it has none; ``_ALONE``
    for those whose bare form depends on neighbours or is longer."""
    import numpy as np

    out = np.zeros(sys.maxunicode + 1, dtype="<u4")
    for cp in range(sys.maxunicode + 1):
        low = chr(cp).lower()
        if cp == 0x3A3 or len(low) != 1:  # the small final sigma depends on its place
            out[cp] = _ALONE
        elif low.isalnum():
            out[cp] = ord(low)
    out[list(tables()["unstable"])] = _ALONE
    return out


def bare_texts(texts: list[str | None], one=bare_text) -> list[str | None]:
    """``bare_text`` of many texts by one table look-up; ``one`` is called for the unusual ones."""
    import numpy as np

    flat = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter((len(t) if t else 0 for t in texts), "int64", len(texts))
    made = bare_codes()[flat]
    upto = lambda mask: np.r_[0, np.cumsum(mask)]
    ends = np.r_[0, np.cumsum(size)]
    alone = upto(made == _ALONE)[ends]
    made[made == _ALONE] = 0
    kept = upto(made > 0)[ends].tolist()
    flat_text = made[made > 0].tobytes().decode("utf-32-le", "surrogatepass")
    odd = (np.diff(alone) > 0).tolist()
    return [None if t is None else one(t) if x else flat_text[a:b] for t, x, a, b in zip(texts, odd, kept, kept[1:])]


def bare_bodies(queries: list[str | None]) -> list[str | None]:
    """``bare_body`` of many queries."""
    cut = [q[m.end() :] if q and (m := _STORED.match(q)) and not _python_tools()[1].search(q) else q for q in queries]
    # an unusual query is taken as stored, its instruction included
    return bare_texts(cut, bare_body)
