"""Text of glyph names: a table of plain names, rules over the Unicode database, and, where given, a glyph list file.

Public glyph lists name most characters by a pattern: a letter and its accents, a letter's or digit's name
and its script. Those are looked up in the Unicode database by rule; what follows no rule needs the list itself, which
callers may load with read_glyph_list() and pass in ParseOptions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Names of glyphs that are neither one character nor follow a rule below.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿",
    "AE": "Æ", "Eth": "Ð", "Oslash": "Ø", "Thorn": "Þ", "germandbls": "ß", "ae": "æ", "eth": "ð", "oslash": "ø", "thorn": "þ", "multiply": "×", "divide": "÷", "OE": "Œ", "oe": "œ", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "florin": "ƒ", "Euro": "€",
    "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "guilsinglleft": "‹", "guilsinglright": "›", "endash": "–", "emdash": "—", "ellipsis": "…", "bullet": "•", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "trademark": "™", "minus": "−", "fraction": "⁄", "circumflex": "ˆ", "tilde": "˜", "breve": "˘", "caron": "ˇ", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "hungarumlaut": "˝",
    "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "Delta": "∆", "Omega": "Ω", "infinity": "∞", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "summation": "∑", "product": "∏", "radical": "√", "integral": "∫", "partialdiff": "∂", "approxequal": "≈", "lozenge": "◊", "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "similar": "∼", "element": "∈", "Dcroat": "Đ", "dcroat": "đ", "Hbar": "Ħ", "hbar": "ħ", "Tbar": "Ŧ", "tbar": "ŧ", "Ldot": "Ŀ", "ldot": "ŀ", "Eng": "Ŋ", "eng": "ŋ", "IJ": "Ĳ", "ij": "ĳ", "kgreenlandic": "ĸ", "longs": "ſ", "napostrophe": "ŉ",
}
#: Names of accents, as they follow a letter's name.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "hookabove": "̉", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "dblgrave": "̏", "invertedbreve": "̑", "horn": "̛", "dotbelow": "̣", "dieresisbelow": "̤", "ringbelow": "̥", "commaaccent": "̧", "cedilla": "̧", "ogonek": "̨", "circumflexbelow": "̭", "brevebelow": "̮", "tildebelow": "̰", "linebelow": "̱"}
#: Where a comma below is no cedilla (fixed by the encoding).
_COMMA = {"S": "Ș", "s": "ș", "T": "Ț", "t": "ț"}
_DIGITS = "zero one two three four five six seven eight nine".split()
_SCRIPTS = {"cyrillic": "CYRILLIC", "armenian": "ARMENIAN", "hebrew": "HEBREW", "arabic": "ARABIC", "hiragana": "HIRAGANA", "katakana": "KATAKANA", "deva": "DEVANAGARI", "bengali": "BENGALI", "gurmukhi": "GURMUKHI", "gujarati": "GUJARATI", "thai": "THAI CHARACTER", "bopomofo": "BOPOMOFO"}
_GREEK = {n.lower(): n for n in "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega".split()}
_ACCENTED = re.compile("([A-Za-z]|AE|ae|O|o)((?:" + "|".join(sorted(ACCENTS, key=len, reverse=True)) + ")+)")
_EACH = re.compile("|".join(sorted(ACCENTS, key=len, reverse=True)))
_POINTS = re.compile(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})")


def _named(*names: str) -> str | None:
    """The character with the first of these Unicode names there is."""
    for n in names:
        try:
            return unicodedata.lookup(n)
        except KeyError:
            continue
    return None


def _by_script(name: str) -> str | None:
    for end, script in _SCRIPTS.items():
        stem = name[: -len(end)]
        if not name.endswith(end) or not stem:
            continue
        if stem in _DIGITS:
            digit = "ARABIC-INDIC" if end == "arabic" else script.split()[0]
            return _named(f"{digit} DIGIT {stem.upper()}")
        if end in ("hiragana", "katakana"):
            small = stem.endswith("small")
            return _named(f"{script} LETTER {'SMALL ' * small}{(stem[:-5] if small else stem).upper()}")
        word = stem.upper()
        case = "CAPITAL" if stem[0].isupper() else "SMALL"
        sign = word.removesuffix("VOWELSIGN")
        return _named(f"{script} {case} LETTER {word}", f"{script} LETTER {word}", f"{script} VOWEL SIGN {sign}" if sign != word else "", f"{script} {word}", f"{script} SIGN {word}")
    return None


def _by_shape(name: str) -> str | None:
    for end, form in (("superior", "SUPERSCRIPT {}"), ("inferior", "SUBSCRIPT {}"), ("circle", "CIRCLED DIGIT {}"), ("parenthesized", "PARENTHESIZED DIGIT {}"), ("parens", "PARENTHESIZED DIGIT {}"), ("period", "DIGIT {} FULL STOP"), ("monospace", "FULLWIDTH DIGIT {}")):
        stem = name.removesuffix(end)
        if stem != name and stem in _DIGITS:
            return _named(form.format(stem.upper()))
    letter = name.removesuffix("monospace")
    if letter != name and len(letter) == 1 and letter.isalpha():
        return _named(f"FULLWIDTH LATIN {'CAPITAL' if letter.isupper() else 'SMALL'} LETTER {letter.upper()}")
    base = name.removesuffix("dieresistonos").removesuffix("tonos").removesuffix("dieresis")
    if base.lower() in _GREEK and base in (base.lower(), _GREEK[base.lower()]):
        case = "SMALL" if base == base.lower() else "CAPITAL"
        marks = {"tonos": " WITH TONOS", "dieresis": " WITH DIALYTIKA", "dieresistonos": " WITH DIALYTIKA AND TONOS"}.get(name[len(base) :], "")
        return _named(f"GREEK {case} LETTER {base.upper().replace('LAMBDA', 'LAMDA')}{marks}")
    return None


@lru_cache(1 << 14)
def _ruled(name: str) -> str | None:
    if m := _ACCENTED.fullmatch(name):
        if m.group(2) == "commaaccent" and m.group(1) in _COMMA:
            return _COMMA[m.group(1)]
        letter = GLYPHS.get(m.group(1), m.group(1))
        one = unicodedata.normalize("NFC", letter + "".join(ACCENTS[a] for a in _EACH.findall(m.group(2))))
        if len(one) == 1:
            return one
    return _by_script(name) or _by_shape(name)


def glyph_text(name: str, listed: dict[str, str] | None = None) -> str | None:
    """Text of a glyph name, if it is listed, known, spells its code points or follows a rule."""
    if listed and name in listed:
        return listed[name]
    if len(name) == 1 and name.isprintable():
        return name
    if name in GLYPHS:
        return GLYPHS[name]
    if m := _POINTS.fullmatch(name):
        points = [int(m.group(1)[k : k + 4], 16) for k in range(0, len(m.group(1)), 4)] if m.group(1) else [int(m.group(2), 16)]
        return None if any(p > 0x10FFFF or 0xD800 <= p < 0xE000 for p in points) else "".join(map(chr, points))
    return _ruled(name)


def read_glyph_list(text: str) -> dict[str, str]:
    """name -> text of a glyph list: lines `name;hex hex ...` of UTF-16 units, comments after #; malformed lines are left out."""
    out = {}
    for line in text.splitlines():
        name, _, units = line.partition("#")[0].strip().partition(";")
        try:
            raw = b"".join(int(u, 16).to_bytes(2, "big") for u in units.split())
            if name and raw:
                out[name] = raw.decode("utf-16-be")
        except (ValueError, OverflowError):
            continue
    return out
