"""Script profiles: what the text functions need to know of a script."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScriptProfile:
    """Patterns are Java regular expressions; they hold no look-around, so that other engines read them too."""

    name: str
    #: Replaced before anything else, in order.
    replacements: tuple[tuple[str, str], ...]
    #: One-to-one character map, as two strings.
    fold: tuple[str, str]
    #: Characters that a skeleton leaves out.
    strip: str
    #: A character of the script.
    letter: str
    #: Spelling of the chant token, and rewrites of headers (ordered) with the pattern that finds one.
    chant: str
    headers: tuple[tuple[str, str], ...] = ()
    header: str = ""


# Letters, marks and spellings of the script.
GURMUKHI = ScriptProfile(
    name="gurmukhi",
    replacements=(("ਸ਼", "ਸ"), ("ਖ਼", "ਖ"), ("ਗ਼", "ਗ"), ("ਜ਼", "ਜ"), ("ਫ਼", "ਫ"), ("ਲ਼", "ਲ"), ("ਸ਼", "ਸ"), ("ਖ਼", "ਖ"), ("ਗ਼", "ਗ"), ("ਜ਼", "ਜ"), ("ਫ਼", "ਫ"), ("ਲ਼", "ਲ")),
    fold=("", ""),
    strip=r"[\x{0A01}-\x{0A03}\x{0A3C}\x{0A3E}-\x{0A4D}\x{0A51}\x{0A70}\x{0A71}\x{0A75}\x{0A66}-\x{0A6F}0-9\s\x{200C}\x{200D}।॥॰.,;:!?'\"()\[\]<>]+",
    letter=r"[\x{0A00}-\x{0A7F}]",
    chant="ਵਾਹਿਗੁਰੂ",
    headers=(
        (r"ਸੀ\s*ਰਾਗ\s*ਮਹਲਾ\s*ਪੰ", "ਸ੍ਰੀਰਾਗੁ ਮਹਲਾ ੫"),
        (r"ਸੀਰਾਗ\s*ਮਹਲਾ", "ਸ੍ਰੀਰਾਗੁ ਮਹਲਾ"),
        (r"ਸ੍ਰੀਰਾਗੁ\s*ਮਹਲਾ[^\p{L}\p{N}_]*", "ਸ੍ਰੀਰਾਗੁ ਮਹਲਾ "),
        (r"ਸਿ੍ਰ\s*ਰਾਗੁ?\s*ਮਹਲਾ", "ਸ੍ਰੀਰਾਗੁ ਮਹਲਾ"),
        (r"ਸਿ੍ਰੀਰਾਗੁ\s*ਮਹਲਾ", "ਸ੍ਰੀਰਾਗੁ ਮਹਲਾ"),
        (r"ਸਿਰੀੀ?\s*ਰਾਗੁ?\s*ਮਹਲਾ", "ਸ੍ਰੀਰਾਗੁ ਮਹਲਾ"),
    ),
    header=r"(?:ਸ੍ਰੀ\s*ਰਾਗੁ?|ਸੀ\s*ਰਾਗ|ਸਿ੍ਰ\s*ਰਾਗੁ?|ਸੀਰਾਗ|ਸਿਰੀੀ?\s*ਰਾਗੁ?)\s*ਮਹਲਾ",
)

LATIN = ScriptProfile(
    name="latin",
    replacements=(("ß", "ss"),),
    fold=("áàâäãåéèêëíìîïóòôöõúùûüýÿçñ", "aaaaaaeeeeiiiiooooouuuuyycn"),
    strip=r"[aeiou0-9\s.,;:!?'\"()\[\]<>|%$#&*@=+/_-]+",
    letter=r"[A-Za-zÀ-ÖØ-öø-ÿ]",
    chant="the",
    headers=((r"(?i)chapter\s*([0-9]+)[\s.:-]*", "Chapter $1 "),),
    header=r"(?i)chapter\s*[0-9]+",
)

PROFILES = {p.name: p for p in (GURMUKHI, LATIN)}
