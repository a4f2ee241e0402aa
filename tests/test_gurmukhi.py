"""The font's encoding and Latin letters, against plain loops and known words."""

from __future__ import annotations

import re

import pytest

from quillspark.functions import gurmukhi as G
from quillspark.functions import text as X
from quillspark.functions.profiles import GURMUKHI

WORDS = [("siq nwmu", "ਸਤਿ ਨਾਮੁ", "sati namu"), ("krqw purKu", "ਕਰਤਾ ਪੁਰਖੁ", "karata purakhu"), ("inrBau", "ਨਿਰਭਉ", "nirabhau"), ("<> vwihgurU ]1]", "ੴ ਵਾਹਿਗੁਰੂ ॥੧॥", "vahiguru"),
         ("pRBU", "ਪ੍ਰਭੂ", "prabhu"), ("AwpY", "ਆਪੈ", "apai"), ("is`K", "ਸਿੱਖ", "sikha"), ("Sbd", "ਸ਼ਬਦ", "sabada"), ("", "", ""), (None, None, None)]


def test_known_words(spark):
    rows = spark.createDataFrame(WORDS, "a string, u string, r string")
    for row in rows.select("u", "r", G.ascii_to_unicode(rows["a"]).alias("gu"), G.roman(rows["u"]).alias("gr")).collect():
        assert (row.gu, row.gr) == (row.u, row.r)


def plain_unicode(text):
    for pattern, by in G.ASCII_ORDER:
        text = re.sub(pattern, by.replace("$", "\\"), text)
    for key in G.ASCII_PAIRS:
        text = text.replace(key, G.ASCII_PAIRS[key])
    return "".join(G.ASCII_SIGNS.get(c, c) for c in text)


@pytest.mark.parametrize("seed", range(2))
def test_every_sign(spark, seed):
    import random

    rng = random.Random(seed)
    signs = [*G.ASCII_SIGNS, *G.ASCII_PAIRS, " ", "?", "ਕ", "\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)] + list(signs)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(G.ascii_to_unicode(rows["t"])).collect()]
    assert got == [plain_unicode(t) for t in texts]
    # Unicode goes through unchanged, so a second conversion adds nothing where no ASCII is left.
    again = spark.createDataFrame([(t,) for t in got if not re.search("[!-~]", t)], "t string")
    assert all(a == b for a, b in again.select("t", G.ascii_to_unicode(again["t"])).collect())


def test_skeletons_of_converted_text_agree(spark):
    rows = spark.createDataFrame(WORDS[:8], "a string, u string, r string")
    pairs = rows.select(X.skeleton(G.ascii_to_unicode(rows["a"]), GURMUKHI), X.skeleton(rows["u"], GURMUKHI)).collect()
    assert all(a == b for a, b in pairs) and any(a for a, _ in pairs)


def test_skeleton_in_a_single_pass(spark):
    import random

    rng = random.Random(6)
    signs = [*map(chr, range(0x0A00, 0x0A80)), *" \t\n\v\f\r\u0085  ‌‍।॥॰.,;:!?'\"()[]<>0189AzÉßİ🙂\\-", *(a for a, _ in GURMUKHI.replacements)]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)] + signs + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(X.skeleton(rows["t"], GURMUKHI), G.skeleton(rows["t"]))
    assert all(a == b for a, b in found.collect())
    plan = rows.select(G.skeleton(rows["t"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "replace(" not in plan
