"""Validation of proposed corrections and the choice among candidates."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import grams as G
from quillspark.functions import text as X
from quillspark.functions.profiles import LATIN, ScriptProfile
from quillspark.operators.align import _python_skeleton


def drift(caption: Column, proposed: Column) -> Column:
    """Difference of token counts."""
    return F.abs(F.size(proposed) - F.size(caption))


def invented(caption: Column, proposed: Column, vocabulary: Column, profile: ScriptProfile = LATIN, some=F.filter) -> Column:
    """Proposed tokens that neither caption nor work has, nor a work token within one edit of the skeleton.

    With ``some`` = F.exists: whether there are any; the first one ends the search.
    """
    def of(v: Column) -> Column:
        c, words, bones = v["c"], v["w"], v["b"]

        def known(t):
            def near(own):
                return (own != "") & (F.array_contains(bones, own) | F.exists(bones, lambda s: F.levenshtein(s, own, 1) >= 0))

            return F.array_contains(c, t) | F.array_contains(words, t) | G.let(X.skeleton(t, profile), near)

        return some(v["p"], lambda t: ~known(t))

    bones = F.filter(F.transform(vocabulary, lambda t: X.skeleton(t, profile)), lambda s: s != "")
    return G.let(F.struct(caption.alias("c"), vocabulary.alias("w"), F.array_distinct(bones).alias("b"), proposed.alias("p")), of)


def bad_substitutions(caption: Column, proposed: Column, profile: ScriptProfile = LATIN) -> Column:
    """Positions where token counts agree but a token was replaced by more than a vowel fix or one consonant."""
    pairs = F.arrays_zip(caption.alias("c"), proposed.alias("p"))

    def bad(pair):
        def far(v):
            a, b = v["a"], v["b"]
            return (a != b) & ((a == "") | (b == "") | (F.abs(F.length(a) - F.length(b)) > 1) | (F.levenshtein(a, b) > 1))

        return (pair["c"] != pair["p"]) & G.let(F.struct(X.skeleton(pair["c"], profile).alias("a"), X.skeleton(pair["p"], profile).alias("b")), far)

    flags = F.transform(pairs, bad)
    at = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    return F.when(F.size(caption) == F.size(proposed), at).otherwise(F.array().cast("array<int>"))


def _places(a: str, where: dict[str, list[int]], by_size: dict[int, list[str]]) -> list[tuple[int, bool]]:
    """Where a skeleton is met, in order, and whether by a part; the maps have the places, and the sizes, of different ones."""
    parts = [b for b in where if b in a or a in b]
    found = [(j, b != a) for b in parts for j in where[b]]
    n = len(a)
    if n >= 2:
        half = n // 2
        head, tail = a[:half], a[half:]
        for b in by_size.get(n, ()):  # one letter may differ: then one half agrees
            if b != a and (b.startswith(head) or b.endswith(tail)) and sum(x != y for x, y in zip(a, b, strict=True)) <= 1:
                found += [(j, False) for j in where[b]]
    return sorted(found)


def _met(mine: list[str], theirs: list[str]) -> int:
    where: dict[str, list[int]] = {}
    for j, b in enumerate(theirs):
        if b:
            where.setdefault(b, []).append(j)
    by_size: dict[int, list[str]] = {}
    for b in where:
        by_size.setdefault(len(b), []).append(b)
    found: dict[str, list[tuple[int, bool]]] = {}
    at = hits = 0
    for bones in mine:
        if not bones:
            hits += 1
            continue
        if (own := found.get(bones)) is None:
            own = found[bones] = _places(bones, where, by_size)
        k = bisect_left(own, (at, False))
        if k < len(own):
            j, part = own[k]
            hits, at = hits + 1, j if part else j + 1
    return hits


def preserved_share(profile: str = "latin"):
    """Column function (caption tokens, proposed tokens) -> share of caption skeletons met in order.

    The search position is carried along, so this is a fold over both arrays and runs as an Arrow function.
    """

    @F.pandas_udf("double")
    def share(caption: pd.Series, proposed: pd.Series) -> pd.Series:
        skeleton, out = _python_skeleton(profile), []
        for c, p in zip(caption, proposed, strict=True):
            mine, theirs = [skeleton(t) for t in c], [skeleton(t) for t in p]
            out.append(_met(mine, theirs) / len(mine) if mine else 1.0)
        return pd.Series(out)

    return share


def reasons(caption: Column, proposed: Column, vocabulary: Column, profile: ScriptProfile = LATIN, max_drift: int = 1, least_share: float = 0.6, share: Column | None = None) -> Column:
    """Why a proposed text fails; empty if it passes or is the caption itself. ``share`` replaces the Python fold where it is known."""
    c, p = X.tokenize(caption), X.tokenize(proposed)
    share = preserved_share(profile.name)(c, p) if share is None else share

    def found(v: Column) -> Column:
        a, b = v["c"], v["p"]
        return F.struct((drift(a, b) > max_drift).alias("drift"), invented(a, b, v["w"], profile, F.exists).alias("invented"), (F.size(bad_substitutions(a, b, profile)) > 0).alias("substitution"))

    def named(v: Column) -> Column:
        return F.array(F.when(v["f"]["drift"], "drift"), F.when(v["f"]["invented"], "invented"), F.when(v["s"] < least_share, "order"), F.when(v["f"]["substitution"], "substitution"))

    flags = G.let(F.struct(c.alias("c"), p.alias("p"), vocabulary.alias("w")), found)
    checks = G.let(F.struct(flags.alias("f"), share.alias("s")), named)
    return F.when(F.trim(caption) == F.trim(proposed), F.array().cast("array<string>")).otherwise(F.filter(checks, lambda r: r.isNotNull()))


def verify_output(caption: Column, proposed: Column, vocabulary: Column, profile: ScriptProfile = LATIN, max_drift: int = 2) -> Column:
    """The lighter check: few tokens more or less, and every token known to the work within one edit of the skeleton."""
    c, p = X.tokenize(caption), X.tokenize(proposed)
    return (drift(c, p) <= max_drift) & (F.size(invented(F.array().cast("array<string>"), p, vocabulary, profile)) == 0)


def coerce_verdict(verdict: Column) -> Column:
    """APPROVE, IMPROVED or REJECT; anything else rejects."""
    v = F.upper(F.trim(verdict))
    return F.when(v.isin("APPROVE", "IMPROVED", "REJECT"), v).otherwise("REJECT")


def verdict_text(verdict: Column, improved: Column, corrected: Column, caption: Column) -> Column:
    return F.when(verdict == "APPROVE", corrected).when(verdict == "REJECT", caption).otherwise(F.coalesce(improved, caption))


def pick(*candidates: tuple[Column, Column, Column, str], default: Column) -> Column:
    """Struct (text, decision, source) of the first candidate (text, valid, decision, source) that is valid; else the caption."""
    out = F.struct(default.alias("text"), F.lit("validator_fallback").alias("decision"), F.lit("caption").alias("source"))
    for text, valid, decision, source in reversed(candidates):
        out = F.when(F.coalesce(valid & text.isNotNull(), F.lit(False)), F.struct(text.alias("text"), decision.alias("decision"), F.lit(source).alias("source"))).otherwise(out)
    return out


#: Decisions whose rows may train.
USABLE = ("exact", "matched", "replaced", "replaced_llm", "replaced_reviewed", "unchanged_noop", "simran")


def usable(decision: Column) -> Column:
    return F.coalesce(decision.isin(*USABLE), F.lit(False))


def stage2_candidate(decision: Column, work: Column) -> Column:
    return F.coalesce((decision == "review") | ((decision == "unchanged") & work.isNotNull()), F.lit(False))


def salvageable(decision: Column, verdict: Column, improved: Column, caption: Column, valid: Column) -> Column:
    """Rows that fell back on an error although a valid improvement exists."""
    return F.coalesce((decision == "error_fallback") & (verdict == "IMPROVED") & (improved != caption) & valid, F.lit(False))


