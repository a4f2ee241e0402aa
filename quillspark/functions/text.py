"""Scalar text functions as Column expressions; all run inside the JVM but ``nfc``."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.grams import let
from quillspark.functions.profiles import LATIN, ScriptProfile

_EMPTY = "array<string>"


#: Recogniser artefacts.
UNKNOWN = "unk>|un>|<unk?>?|<k>?|<un"


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokenize(text: Column, marker: str = ">>") -> Column:
    """Non-empty pieces between white space, without marker tokens; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.filter(parts, lambda t: (t != "") & (t != marker))


def folded(text: Column, profile: ScriptProfile = LATIN) -> Column:
    """A text in lower case, letters as the profile has them; null gives the empty string."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), profile.replacements, out)
    return F.translate(out, *profile.fold) if profile.fold[0] else out


def skeleton(text: Column, profile: ScriptProfile = LATIN) -> Column:
    """The consonants of a text under a profile; null gives the empty string."""
    return F.regexp_replace(folded(text, profile), profile.strip, "")


def skeletons(text: Column, profile: ScriptProfile = LATIN) -> Column:
    """The skeletons of a text's tokens with the white space between them: one call for all."""
    return F.regexp_replace(folded(text, profile), profile.strip.replace(r"\s", "", 1), "")


def clean_token(token: Column) -> Column:
    """Without pause marks, digits and dots at its end."""
    return F.trim(F.regexp_replace(token, r"[॥।੦-੯0-9.]+$", ""))


def is_pause_token(token: Column) -> Column:
    return token.rlike(r"^[॥।੦-੯0-9.,;:!?'\"()\[\]]+$")


def strip_unknown(text: Column) -> Column:
    """Recogniser artefacts such as <unk>, <un and <k> as blanks, collapsed."""
    return collapse(F.regexp_replace(text, UNKNOWN, " "))


# Verse marks, and what captions put in brackets.
VERSE_NUMBER = "॥[੦-੯]+॥"
DOUBLE_DANDA = "॥"
CAPTION_TAGS = r"(?i)\[[^\]]*\]|\(\s*(?:music|sangit|applause|laughter|instrumental)\s*\)"
CAPTION_MARKS = "॥[੦-੯0-9]*॥|॥|।"


def strip_verse_marks(text: Column, joint: str = "") -> Column:
    """Numbered and bare double marks replaced by ``joint`` ('' for training text, ' ' for matching)."""
    return collapse(F.regexp_replace(F.regexp_replace(text, VERSE_NUMBER, joint), DOUBLE_DANDA, joint))


def strip_caption(text: Column) -> Column:
    """Tags in brackets and verse marks, single and double, as blanks, zero-width characters away."""
    out = F.regexp_replace(F.regexp_replace(text, CAPTION_TAGS, " "), CAPTION_MARKS, " ")
    return collapse(F.regexp_replace(out, r"[\x{200C}\x{200D}]", ""))


def normalize_word(word: Column) -> Column:
    """Lower case without marks at either end, for comparing words of two transcripts."""
    return F.regexp_replace(F.lower(F.trim(word)), r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$", "")


def has_script(text: Column, profile: ScriptProfile = LATIN) -> Column:
    return text.rlike(profile.letter)


def script_chars(text: Column, profile: ScriptProfile = LATIN) -> Column:
    """Number of characters of the script."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(profile.letter)).cast("long")


def script_share(text: Column, profile: ScriptProfile = LATIN) -> Column:
    """Characters of the script per character that is not white space; 0 for none."""
    dense = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))
    return F.when(dense > 0, script_chars(text, profile) / dense).otherwise(F.lit(0.0))


def script_tokens(tokens: Column, profile: ScriptProfile = LATIN) -> Column:
    """Number of tokens with a character of the script."""
    return F.size(F.filter(tokens, lambda t: t.rlike(profile.letter)))


def chant_tokens(tokens: Column, profile: ScriptProfile = LATIN) -> Column:
    """For each token whether its skeleton is the chant token's."""
    return F.transform(tokens, lambda t: skeleton(t, profile) == skeleton(F.lit(profile.chant), profile))


def normalize_chant(tokens: Column, profile: ScriptProfile = LATIN) -> Column:
    """Spellings of the chant token as the canonical one."""
    return F.transform(tokens, lambda t: F.when(skeleton(t, profile) == skeleton(F.lit(profile.chant), profile), profile.chant).otherwise(t))


def clean_text(text: Column, profile: ScriptProfile = LATIN) -> Column:
    """Struct (text, changed): artefacts stripped, other scripts blanked, chant tokens normalised and how many changed."""
    # Runs of anything else, white space as well, become one blank: no pass of its own for either.
    kept = F.trim(F.regexp_replace(F.regexp_replace(text, UNKNOWN, " "), profile.letter.replace("[", "[^", 1) + "+", " "))
    chant = skeleton(F.lit(profile.chant), profile)

    def of(parts: Column) -> Column:
        pairs = F.filter(parts, lambda p: p["t"] != "")
        after = F.transform(pairs, lambda p: F.when(p["b"] == chant, profile.chant).otherwise(p["t"]))
        changed = F.size(F.filter(pairs, lambda p: (p["b"] == chant) & (p["t"] != profile.chant)))
        return F.struct(F.array_join(after, " ").alias("text"), changed.cast("long").alias("changed"))

    def zipped(k: Column) -> Column:
        return F.arrays_zip(F.split(k, " ").alias("t"), F.split(skeletons(k, profile), " ").alias("b"))

    return let(let(F.coalesce(kept, F.lit("")), zipped), of)


def normalize_header(text: Column, profile: ScriptProfile = LATIN) -> Column:
    """Header spellings rewritten in the profile's order."""
    return collapse(reduce(lambda acc, rule: F.regexp_replace(acc, *rule), profile.headers, text))


def split_at_headers(text: Column, profile: ScriptProfile = LATIN, least_offset: int = 4) -> Column:
    """Parts of a text, cut before each header that starts at ``least_offset`` or later."""
    marked = F.regexp_replace(F.substring(text, least_offset + 1, 1 << 30), f"({profile.header})", "\x01$1")
    parts = F.split(F.concat(F.substring(text, 1, least_offset), marked), "\x01")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def first_letters(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.substring(t, 1, 1))


def tail(text: Column, size: int = 140) -> Column:
    """The last ``size`` characters, from a word's start if one begins early enough (not in the last four)."""
    cut = F.when(F.length(text) <= size, text).otherwise(F.substring(text, -size, size))
    blank = F.locate(" ", cut) - 1
    snaps = (F.length(text) > size) & (blank > 0) & (blank < F.length(cut) - 4)
    return F.when(snaps, F.substr(cut, blank + 2)).otherwise(cut)


def seam_merge(before: Column, after: Column, cap: int = 12) -> Column:
    """Two token arrays joined, without the longest overlap (at most ``cap``) of the first's end and the second's start."""
    def joined(p: Column) -> Column:
        a, b = p["a"], p["b"]
        sizes = F.sequence(F.lit(cap), F.lit(1), F.lit(-1))
        fits = F.filter(sizes, lambda n: (n <= F.size(a)) & (n <= F.size(b)) & (F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) == F.slice(b, F.lit(1), n)))
        return F.concat(a, F.slice(b, F.coalesce(F.get(fits, F.lit(0)), F.lit(0)) + 1, F.greatest(F.size(b), F.lit(1))))

    return let(F.struct(before.alias("a"), after.alias("b")), joined)


def longest_run(tokens: Column) -> Column:
    """Length of the longest run of equal neighbouring tokens; 0 for none."""
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, t):
        run = F.when(acc["last"] == t, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(tokens, zero, step, lambda a: a["best"])


def longest_true_run(flags: Column) -> Column:
    """Length of the longest run of true flags."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, flag):
        run = F.when(flag, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(flags, zero, step, lambda a: a["best"])


def dominant_token(tokens: Column) -> Column:
    """Struct (token, n) of the most frequent token, the first to appear among equals; null for none."""
    def best(t: Column) -> Column:
        # In order of token and place, equal tokens are neighbours: where one begins, the next beginning tells its number.
        at = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("token"), i.alias("at"))))
        return let(at, runs)

    def runs(at: Column) -> Column:
        begins = F.filter(F.transform(at, lambda x, k: F.struct(k.alias("k"), x.alias("x"), ((k == 0) | ~F.get(at, k - 1)["token"].eqNullSafe(x["token"])).alias("new"))), lambda y: y["new"])
        return let(begins, lambda b: F.when(F.size(b) > 0, F.array_max(counted(at, b))))

    def counted(at: Column, b: Column) -> Column:
        after = lambda j: F.coalesce(F.get(b, j + 1)["k"], F.size(at))
        return F.transform(b, lambda y, j: F.struct((after(j) - y["k"]).alias("n"), (-y["x"]["at"]).alias("at"), y["x"]["token"].alias("token")))

    return let(tokens, best)


def suppress_single_token(text: Column) -> Column:
    """The empty string for texts of at least four tokens that are all the same."""
    t = tokenize(text)
    return F.when((F.size(t) >= 4) & (F.size(F.array_distinct(t)) == 1), "").otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_slug(text: Column, size: int = 80) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9\-_]+", "_"), 1, size)


def parse_size(text: Column) -> Column:
    """Bytes of a size such as '12.3 MB' (decimal units); 0 if it cannot be read."""
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*([KMGkmg]?)[Bb]?", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*([KMGkmg]?)[Bb]?", 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)
    return F.coalesce((number * factor).cast("long"), F.lit(0).cast("long"))


def estimated_seconds(size_bytes: Column, bits_per_second: int = 128_000) -> Column:
    return F.when(size_bytes > 0, F.round(size_bytes * 8 / bits_per_second, 1)).otherwise(F.lit(0.0))


def url_offset(url: Column) -> Column:
    """Seconds of a url's t parameter; a unit after it is not read; null if there is none."""
    return F.regexp_extract(url, r"[?&]t=([0-9]+)", 1).try_cast("long")


def url_parameter(url: Column, name: str) -> Column:
    return F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(name)))


def filename_fields(name: Column, least: int = 5) -> Column:
    """Parts of a file name between underscores, without its extension; null if there are fewer than ``least``."""
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "_")
    return F.when(F.size(parts) >= least, parts)


def stable_id(source: Column, *choices: tuple[str, Column], default: Column) -> Column:
    """The id of a row by its source's rule, prefixed with the source."""
    out = default
    for name, value in reversed(choices):
        out = F.when(source == name, F.concat(F.lit(f"{name}_"), value)).otherwise(out)
    return out


def transliterate(text: Column, reorders: tuple[tuple[str, str], ...], words: tuple[tuple[str, str], ...], chars: tuple[str, str]) -> Column:
    """Ordered reorderings, then multi-character replacements (longest first), then a one-to-one map."""
    out = reduce(lambda acc, rule: F.regexp_replace(acc, *rule), reorders, text)
    ordered = sorted(words, key=lambda w: (-len(w[0]), w[0]))
    out = reduce(lambda acc, rule: F.replace(acc, F.lit(rule[0]), F.lit(rule[1])), ordered, out)
    return F.translate(out, *chars)


# Devanagari signs whose counterpart in the Gurmukhi block lies 0x100 above, and those that differ.
PARALLEL_SIGNS = "अआइईउऊएऐओऔकखगघङचछजझञटठडढणतथदधनपफबभमयरलवसहािीुूेैोौ्ंँ०१२३४५६७८९"
OTHER_SIGNS = (("श", "ਸ਼"), ("ष", "ਸ਼"), ("ः", ""), ("क़", "ਕ਼"), ("ख़", "ਖ਼"), ("ग़", "ਗ਼"), ("ज़", "ਜ਼"), ("ड़", "ੜ"), ("ढ़", "ੜ੍ਹ"), ("फ़", "ਫ਼"))


def devanagari_to_gurmukhi(text: Column) -> Column:
    """Sign by sign; letters with a nukta as one, other signs and other scripts stay."""
    return transliterate(text, (), OTHER_SIGNS, (PARALLEL_SIGNS, "".join(chr(ord(c) + 0x100) for c in PARALLEL_SIGNS)))


def looks_devanagari(text: Column, share: float = 0.3) -> Column:
    """Whether more than ``share`` of all characters are Devanagari; false for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")) > share * F.length(text), F.lit(False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def collapse_phrases(tokens: pd.Series) -> pd.Series:
    """Phrases of 3 to 8 tokens said three times or more in a row, once; longer phrases first.  Null stays null.

    For each phrase length the runs of tokens that equal the one a phrase further on are counted from the end, so a
    place is judged without comparing phrases.
    """
    return tokens.map(lambda t: _collapsed(list(t)), na_action="ignore")


def _collapsed(tokens: list, shortest: int = 3, longest: int = 8, least: int = 3) -> list:
    same = {}
    for size in range(shortest, longest + 1):
        run = [0] * (len(tokens) + 1)
        for i in range(len(tokens) - size - 1, -1, -1):
            run[i] = run[i + 1] + 1 if tokens[i] == tokens[i + size] else 0
        same[size] = run
    out, i = [], 0
    while i < len(tokens):
        said = next(((size, same[size][i] // size + 1) for size in range(longest, shortest - 1, -1) if same[size][i] >= size * (least - 1)), (1, 1))
        out += tokens[i : i + said[0]]
        i += said[0] * said[1]
    return out


def strip_pauses(text: Column) -> Column:
    """Without the pause marks ; . and , of annotated lines."""
    return F.translate(text, ";.,", "")


def split_pauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode canonical composition; Spark has no built-in."""
    import unicodedata

    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")
