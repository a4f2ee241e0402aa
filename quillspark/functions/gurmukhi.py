"""Gurmukhi from font-encoded ASCII, and plain Latin letters from Gurmukhi, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.profiles import GURMUKHI

# The font's encoding. Signs that are typed in another order than they are stored, rewritten in this order.
ASCII_ORDER = (
    ("i(.)", "$1i"), ("®", "R"), ("([iMµyY])([RH§ÍÏçœ˜†])", "$2$1"), ("([MµyY])([uU])", "$2$1"),
    ("`([wWIoOyYRH§´ÍÏçœ˜†uU])", "$1`"), ("i([´Î])", "$1i"), ("uo", "ou"),
)
# Letters of several characters, then all others, each with its Unicode text.
ASCII_PAIRS = {"ei": "ਇ", "au": "ਉ", "aU": "ਊ", "eI": "ਈ", "ey": "ਏ", "Aw": "ਆ", "AY": "ਐ", "AO": "ਔ", "AW": "ਆਂ", "<>": "ੴ", "ÅÆ": "ੴ"}
ASCII_SIGNS = {
    "ƒ": "ਨੂੰ", "†": "੍ਟ", "˜": "੍ਨ", "Î": "੍ਯ", "î": "੍ਯ", "ç": "੍ਚ", "œ": "੍ਤ", "M": "ੰ", "H": "੍ਹ", "§": "੍ਹੂ", "i": "ਿ", "I": "ੀ", "u": "ੁ", "U": "ੂ", "y": "ੇ",
    "Y": "ੈ", "N": "ਂ", "o": "ੋ", "O": "ੌ", "R": "੍ਰ", "W": "ਾਂ", "w": "ਾ", "®": "੍ਰ", "´": "ੵ", "Ï": "ੵ", "µ": "ੰ", "μ": "ੰ", "@": "ੑ", "`": "ੱ", "~": "ੱ", "Í": "੍ਵ",
    "Ú": "ਃ", "ü": "ੁ", "|": "ਙ", "¨": "ੂ", "Ø": "", "ˆ": "ਂ", "¤": "ੱ", "a": "ੳ", "A": "ਅ", "b": "ਬ", "B": "ਭ", "c": "ਚ", "C": "ਛ", "d": "ਦ", "D": "ਧ", "e": "ੲ",
    "E": "ਓ", "F": "ਢ", "f": "ਡ", "g": "ਗ", "G": "ਘ", "h": "ਹ", "j": "ਜ", "J": "ਝ", "k": "ਕ", "K": "ਖ", "l": "ਲ", "L": "ਲ਼", "m": "ਮ", "n": "ਨ", "p": "ਪ", "P": "ਫ",
    "q": "ਤ", "Q": "ਥ", "r": "ਰ", "s": "ਸ", "S": "ਸ਼", "t": "ਟ", "T": "ਠ", "v": "ਵ", "V": "ੜ", "x": "ਣ", "X": "ਯ", "z": "ਜ਼", "Z": "ਗ਼", "1": "੧", "2": "੨", "3": "੩",
    "4": "੪", "5": "੫", "6": "੬", "^": "ਖ਼", "7": "੭", "&": "ਫ਼", "8": "੮", "9": "੯", "0": "੦", "[": "।", "]": "॥", "Ò": "॥", "\\": "ਞ", "ï": "ਯ", "Ç": "☬", "¡": "ੴ",
    "æ": "਼", "‚": "❁",
}
# Consonants and vowels in Latin letters without marks.
ROMAN = {
    "ਕ": "k", "ਖ": "kh", "ਗ": "g", "ਘ": "gh", "ਙ": "n", "ਚ": "c", "ਛ": "ch", "ਜ": "j", "ਝ": "jh", "ਞ": "n", "ਟ": "t", "ਠ": "th", "ਡ": "d", "ਢ": "dh", "ਣ": "n", "ਤ": "t",
    "ਥ": "th", "ਦ": "d", "ਧ": "dh", "ਨ": "n", "ਪ": "p", "ਫ": "ph", "ਬ": "b", "ਭ": "bh", "ਮ": "m", "ਯ": "y", "ਰ": "r", "ਲ": "l", "ਵ": "v", "ਸ": "s", "ਹ": "h", "ੜ": "r",
    "ਅ": "a", "ਆ": "a", "ਇ": "i", "ਈ": "i", "ਉ": "u", "ਊ": "u", "ਏ": "e", "ਐ": "ai", "ਓ": "o", "ਔ": "au",
    "ਾ": "a", "ਿ": "i", "ੀ": "i", "ੁ": "u", "ੂ": "u", "ੇ": "e", "ੈ": "ai", "ੋ": "o", "ੌ": "au", "ਂ": "m", "ੰ": "m", "ਃ": "h",
}
#: Letters of the block that are one code point for a consonant and a nukta.
COMPOSED = {"ਲ਼": "ਲ", "ਸ਼": "ਸ", "ਖ਼": "ਖ", "ਗ਼": "ਗ", "ਜ਼": "ਜ", "ਫ਼": "ਫ"}
CONSONANT = "[ਕ-ਹੜ]"
VOWEL_SIGN = "[ਾ-੍]"


def mapped(text: Column, table: dict[str, str]) -> Column:
    """Each key replaced by its value; keys of one character and values of one or none in a single pass.

    No value may hold a key: then the order of the replacements changes nothing.
    """
    single = {k: v for k, v in table.items() if len(k) == 1 and len(v) <= 1}
    kept = sorted(single, key=lambda k: not single[k])  # translate drops the characters that have no counterpart
    out = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), [kv for kv in table.items() if kv[0] not in single], text)
    return F.translate(out, "".join(kept), "".join(single[k] for k in kept))


def ascii_to_unicode(text: Column) -> Column:
    """Text typed for the font, in Unicode: order first, then letters of several characters, then all others.

    Characters without a meaning in the font stay; null stays null.
    """
    ordered = reduce(lambda acc, rule: F.regexp_replace(acc, *rule), ASCII_ORDER, text)
    return mapped(mapped(ordered, ASCII_PAIRS), ASCII_SIGNS)


def skeleton(text: Column) -> Column:
    """``text.skeleton`` of the Gurmukhi profile in a single pass; null gives the empty string.

    A profile's replacement of two characters leaves out one that is stripped anyway; all others are of one character.
    """
    single = {a: b for a, b in GURMUKHI.replacements if len(a) == 1}
    strip = re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", lambda m: f"\\u{m[1]}", GURMUKHI.strip), re.ASCII)
    dropped = [c for c in map(chr, range(1, 0xD800)) if strip.fullmatch(c)]
    if GURMUKHI.fold[0] or any(len(a) > 1 and strip.sub("", a) != b for a, b in GURMUKHI.replacements) or any(c in single for c in dropped):
        raise ValueError("the profile asks for more than one pass")
    # translate drops the characters that have no counterpart
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join([*single, *dropped]), "".join(single.values()))


def roman(text: Column) -> Column:
    """Latin letters a-z and single blanks: a consonant has an a unless a vowel sign or a virama follows; no marks, digits
    or signs remain.  The doubling sign and vowel carriers are silent.  Latin letters stay, in lower case; null stays null."""
    plain = F.replace(mapped(text, COMPOSED), F.lit("਼"), F.lit(""))
    voiced = F.regexp_replace(F.regexp_replace(plain, f"({CONSONANT})", "$1a"), f"a({VOWEL_SIGN})", "$1")
    letters = F.regexp_replace(F.lower(mapped(voiced, ROMAN)), "[^a-z \\t\\n]", "")
    return F.trim(F.regexp_replace(letters, "[ \\t\\n]+", " "))
