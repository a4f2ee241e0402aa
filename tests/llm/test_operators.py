"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import decontaminate, html, langid, licences, minhash, packing, quality, search, toxicity, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
#: Names that operators use inside; a table may have them too.
CLASH = ["k", "t", "th", "n", "w", "fp", "s", "len", "win", "item", "label", "id", "key", "band", "text_hash", "score", "_q_id", "h", "q", "start", "length"]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def docs(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], schema)


ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, prose(4, 40)), (4, prose(4, 40)), (5, prose(4, 40)), (None, prose(6, 30)), (None, None), (7, prose(7, 30_000)), (8, "é ÅÄÖ İ ß ½ ²  x <|endoftext|> don't 12ab"), (9, "one")]


def test_every_operator_takes_odd_and_empty_tables(spark):
    model = toxicity.Model(scores={"waa$": 3.0})
    target = quality.Model(np.zeros(quality.BUCKETS))
    speech = langid.fit(spark.createDataFrame([(prose(1, 50), "en"), (prose(2, 50).upper() + " ñ é ü", "es"), (None, "es"), ("x", None)], "t string, l string"), "t", "l")
    item = spark.createDataFrame([(1, prose(4, 12)), (2, None), (3, ""), (4, prose(99, 5))], "item_id long, text string")
    operators = {
        "pack": lambda d: packing.pack(d, TOKENIZER), "contamination": lambda d: decontaminate.contamination(d, item), "near": minhash.near_duplicates, "toxic": lambda d: toxicity.score(d, model),
        "quality": lambda d: quality.resample(d, target), "lang": lambda d: langid.identify(d, speech), "licence": licences.scan, "search": lambda d: search.top_k(d, d, k=3),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, model), "keep": lambda d: quality.keep_selected(d, target), "dedup": minhash.drop_near_duplicates, "clean": lambda d: decontaminate.drop_contaminated(d, item),
    }
    for name, run in operators.items():
        found = run(docs(spark, ODD)).collect()
        assert run(docs(spark, [])).count() == 0, name
        if name in ("toxic", "quality", "lang", "licence", "near"):
            assert len(found) == len(ODD), name
        if name in ("drop_toxic", "keep", "dedup", "clean"):
            assert run(docs(spark, ODD)).columns == docs(spark, ODD).columns, name


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i, prose(i, 3 + 37 * i)) for i in range(120)] + [r for r in ODD if r[0] and r[0] > 5] + [(500, None)]
    rows = [(1000 + i, t) for i, (_, t) in enumerate(rows)]
    found = packing.pack(docs(spark, rows).repartition(3), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    by_doc, by_seq = {}, {}
    for r in found:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for key, text in rows:
        pieces = sorted(by_doc[key], key=lambda r: r.start)
        expected = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert [x for p in pieces for x in p.ids] == expected and {p.doc_tokens for p in pieces} == {len(expected)}
        assert [p.start for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
        assert sum(p.length for p in pieces) <= 4096
    assert packing.padding(packing.pack(docs(spark, rows), TOKENIZER, with_ids=False)).first()["share"] < 0.01


def test_harmonic_classes():
    """A closed bin of class j below the last holds j whole documents and the head of one more, unless they fill it exactly."""
    rng, bins = np.random.default_rng(4), packing.HarmonicBins(64, 8, 0)
    sizes = [*rng.integers(1, 200, 3000).tolist(), 64, 32, 32, 16, 16, 16, 16]
    closed = [pieces for i, n in enumerate(sizes) for _, pieces in bins.add(i, b"\0\0\0\0" * n)]
    last = list(bins.finish())
    assert all(sum(len(p[1]) // 4 for p in pieces) == 64 for pieces in closed) and all((sum(len(p[1]) // 4 for p in pieces)).bit_count() == 1 for _, pieces in last)
    assert sum(len(p[1]) // 4 for pieces in [*closed, *(x for _, x in last)] for p in pieces) == sum(sizes)
    for pieces in closed:
        lengths = [len(p[1]) // 4 for p in pieces]
        if 1 < len(pieces) and min(lengths[:-1]) > 8:
            class_ = 64 // lengths[0]
            assert {64 // n for n in lengths[:-1]} == {class_} and len(pieces) in (class_, class_ + 1)
            assert all(p[2] + len(p[1]) // 4 == p[3] for p in pieces[:-1])  # whole, or the end of a document
    per_document = len([p for pieces in closed for p in pieces]) / len(sizes)
    assert per_document < 3 and len({i for i, _ in last}) == len(last)


def test_pack_splits_words_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    whole, cached = Tokenizer.from_file(TOKENIZER), packing.WordCachedTokenizer(TOKENIZER)
    low = [chr(i) for i in range(256)]
    texts = [f"a{c}b" for c in low] + [f"a {c}{d} 1" for c in low for d in "\x1c\x1d\x1e\x1f\x85\xa0 a1."]
    for text, ids in zip(texts, cached.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(text, items, span=10):
    w, hit, found = plain_words(text), set(), set()
    for key, body in items:
        b = plain_words(body)
        n = min(span, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_contamination_against_brute_force(spark, broadcast_rows):
    items = [(i, prose(1000 + i, 25)) for i in range(6)] + [(10, "Short Item here"), (11, "nine words are one window of their own yes"), (12, prose(1000, 25)), (13, None), (14, "same same same same same same same same same same same same"), (15, "x")]
    rows = [(i, prose(i, 200)) for i in range(10)]
    rows += [(20, prose(1, 30) + " " + items[0][1] + " " + prose(2, 30)), (21, " ".join(items[1][1].split()[3:15])), (22, " ".join(items[1][1].split()[3:12])), (23, "SHORT item, here! and x"), (24, items[7][1].upper()), (25, "same " * 40), (26, None), (27, ""), (28, items[2][1] + " " + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("fp", F.lit(1))
    found = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs(spark, rows), bench, broadcast_rows=broadcast_rows).collect()}
    assert found == {k: plain_contamination(t, items) for k, t in rows}
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()}
    assert kept == {k for k, v in found.items() if not v[1]}
    again = [(1, "a b"), (1, "a b"), (None, "x"), (None, "x"), (1, "c"), (None, None), (None, None), (2, items[0][1]), (2, items[0][1])]
    found = [(r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(docs(spark, again).coalesce(1), bench, broadcast_rows=broadcast_rows).collect()]
    assert sorted(found, key=str) == sorted([(k, *plain_contamination(t, items)[:2]) for k, t in again], key=str)


def plain_components(rows, num, den):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if u and den * i >= num * u:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("similarity", [(85, 100), (80, 100)])
def test_near_duplicates_against_brute_force(spark, similarity):
    rng = np.random.default_rng(5)
    rows = [(i, prose(i, 120)) for i in range(60)] + [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "b a")]
    for i in range(160):  # copies of a few texts with more and more changes, so that pairs fall on both sides of the threshold
        words = prose(i % 4, 120).split()
        for at in rng.integers(0, len(words), int(rng.integers(0, 6))):
            words[at] = "changed" + str(i)
        rows.append((100 + i, " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows), similarity).collect()}
    assert found == plain_components(rows, *similarity)


def test_components_of_chains(spark):
    n, rng = 600, np.random.default_rng(3)
    falling, shuffled = [1, *range(n, 1, -1)], (rng.permutation(n) + 1001).tolist()
    rows = list(itertools.pairwise(falling)) + [(b, a) for a, b in itertools.pairwise(shuffled)]
    rows += [(3000, 3000 + i) for i in range(1, 50)] + [(4000 + i, 4050) for i in range(50)] + [(5000, 5000), *rows[:9]]
    found = {r.id: r.label for r in minhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    expected = dict.fromkeys(falling, 1) | dict.fromkeys(shuffled, 1001) | dict.fromkeys(range(3000, 3050), 3000)
    assert found == expected | dict.fromkeys(range(4000, 4051), 4000) | {5000: 5000}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_lose_no_link_to_short_hashes():
    """Sets whose 64-bit hashes share their upper halves: short sets are smaller than the sets themselves."""
    import pyarrow as pa

    table = minhash.least_matches(0.8, 1e-6, 125, 25)
    signature = np.arange(125, dtype=np.uint32).tobytes()

    def links(common: int, own: int, upper: int) -> list[tuple[int, int]]:
        rows = []
        for k in (1, 2):
            full = [(x % upper) << 32 | x for x in range(common)] + [((x + k * 1_000_000) % upper) << 32 | k << 20 | x for x in range(own)]
            short = np.unique((np.array(full, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32))
            rows.append((0, 7, 0, 0, k, k, len(set(full)), signature, short.tobytes(), -1))
        columns = ["place", "band", "lo", "hi", "id", "label", "n", "sig", "small", "side"]
        batch = pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows])
        out = [b.to_pylist() for b in minhash._block_links(table, 5, 125, 80, 100)(iter([batch]))]
        return [(r["a"], r["b"]) for part in out for r in part]

    assert links(900, 100, 2**31) == [(1, 2)]  # similarity 900 / 1100, hardly a collision
    assert links(900, 100, 300) == [(1, 2)]  # 300 short hashes stand for 1000
    assert links(500, 500, 2**31) == []


def test_bayesian_bounds():
    rows, bands = minhash.plan_bands(0.85, 1e-6)
    assert (1 - 0.85**rows) ** bands <= 1e-6
    table = minhash.least_matches(0.85, 1e-6, 120, 15)
    assert all(0 <= m <= n * 0.85 for n, m in table) and [m for _, m in table] == sorted(m for _, m in table)


def plain_segments(values):
    """Ruzzo and Tompa's definition: all maximal subsequences, by recursion on the best one."""
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += values[j]
                if total > 0 and (top is None or total > top[2] + 1e-12):
                    top = (i, j + 1, total)
        if top is None:
            return []
        return best(lo, top[0]) + [top] + best(top[1], hi)

    return best(0, len(values))


def test_segments_against_definition():
    rng = np.random.default_rng(1)
    for _ in range(40):
        values = rng.choice([-2.5, -1.25, -0.5, 1.0, 2.25, 3.5], 14) + rng.normal(0, 0.01, 14)
        got = toxicity.maximal_segments(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(values)]


def test_toxicity_learns(spark):
    bad = ["grumble", "snarl", "hissing"]
    rows = [(i, prose(i, 60) + (" " + bad[i % 3] + " " + prose(i + 5000, 5) + " " + bad[(i + 1) % 3] if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "i long, t string, y int"), "i", "t", "y")
    fresh = spark.createDataFrame([(1, prose(9001, 80)), (2, prose(9002, 40) + " snarl grumble " + prose(9003, 40)), (3, None)], "doc_id long, text string")
    score = {r.doc_id: r for r in toxicity.score(fresh, model).collect()}
    assert score[1].score < 0.3 <= score[2].score and score[3].score < 0.3
    assert any(s.token <= 40 < s.end for s in score[2].segments)


def test_language_mixture(spark):
    de, en = "der hund und die katze sind nicht hier aber dort im garten ", "the dog and the cat are not here but over there in the garden "
    model = langid.fit(spark.createDataFrame([(de * 20, "de"), (en * 20, "en")], "t string, l string"), "t", "l")
    half = model.mixture(de * 5 + en * 5)
    assert set(half) == {"de", "en"} and abs(half["de"] - 0.5) < 0.15
    assert list(model.mixture(de * 3)) == ["de"] and model.mixture("123 !?") == {} and model.mixture(None) == {}


def test_language_mixture_against_plain_em(spark):
    """Proportions, likelihoods and the chosen set, from counts of trigrams in plain Python."""
    rng = np.random.default_rng(12)
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "efghab"}
    write = lambda lang, n, seed: " ".join("".join(np.random.default_rng(seed * 1000 + i).choice(list(letters[lang]), 4)) for i in range(n))
    train = [(write(x, 400, k), x) for k, x in enumerate(letters)]
    model = langid.fit(spark.createDataFrame(train, "t string, l string"), "t", "l")

    def plain_counts(text: str) -> Counter:
        padded = " " + " ".join(text.split()) + " "
        return Counter(padded[i : i + 3] for i in range(len(padded) - 2))

    for _ in range(8):
        a, b = rng.choice(list(letters), 2, replace=False)
        text = write(a, int(rng.integers(20, 80)), int(rng.integers(50, 99))) + " " + write(b, int(rng.integers(0, 80)), int(rng.integers(50, 99)))
        ids, counts = langid.trigram_counts(text)
        assert sum(counts) == sum(plain_counts(text).values())
        p = np.exp(model.log_p[ids])

        def em(chosen, p=p, counts=counts):
            share = [1 / len(chosen)] * len(chosen)
            for _ in range(25):
                new = [0.0] * len(chosen)
                for row, n in zip(p, counts, strict=True):
                    joint = sum(s * row[c] for s, c in zip(share, chosen, strict=True))
                    for k, c in enumerate(chosen):
                        new[k] += n * share[k] * row[c] / joint
                new = [x / sum(counts) for x in new]
                moved, share = max(abs(x - y) for x, y in zip(new, share, strict=True)), new
                if moved < 1e-4:
                    break
            return share, sum(n * np.log(sum(s * row[c] for s, c in zip(share, chosen, strict=True))) for row, n in zip(p, counts, strict=True))

        order = np.argsort(-np.array(em([0, 1, 2])[0]), kind="stable").tolist()
        found, best = None, -np.inf
        for size in (1, 2, 3):
            share, likelihood = em(order[:size])
            value = likelihood - (size - 1) * np.log(sum(counts))
            if value <= best:
                break
            found, best = {model.languages[c]: s for c, s in zip(order[:size], share, strict=True)}, value
        got = model.mixture(text)
        assert set(got) == set(found) and all(abs(got[k] - v) < 1e-6 for k, v in found.items())


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 1200
    rows = [(1, "http://a/1", big), (2, "http://a/2 x\r\nWARC-Type: bad", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", big[:-1]), (6, "u", big[:-1]), (None, "u", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    warc.write(pages, str(tmp_path / "w"), archive_bytes=600)
    found = warc.captures(warc.read(spark, str(tmp_path / "w"))).collect()
    assert len(found) == len(rows) and all(r.request is not None and r.metadata is not None for r in found)
    by_page = {}
    for r in found:
        page = re.search(r"page-id: (.*)\r\n", r.metadata["fields"])[1]
        by_page.setdefault(page, []).append(r)
    assert by_page["2"][0].kind == "response" and bytes(by_page["2"][0].payload).decode() == big
    assert by_page["1"][0].kind == "revisit" and by_page["1"][0].refers_to == by_page["2"][0].record_id
    assert [r.kind for r in by_page["3"] + by_page["4"] + by_page["5"]] == ["response"] * 3
    assert sorted(r.kind for r in by_page["6"]) == ["response", "revisit"]
    assert warc.sha1_hex(by_page["1"][0].digest) == hashlib.sha1(big.encode()).hexdigest()
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.resolve(warc.captures(warc.read(spark, str(tmp_path / "e")))).count() == 0
    files = sorted((tmp_path / "w").glob("*.txt"))
    assert len(files) > 3
    for f in files:  # an archive is what any gzip reader takes
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_warc_transactions_answer_from_what_is_read(spark, tmp_path):
    big = "<p>" + "y" * 2000
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "u", big), (4, "u", "z" * 1500)], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.txt")
    whole = gzip.decompress(file.read_bytes())

    def answers(data: bytes):
        (tmp_path / "x").mkdir(exist_ok=True)
        (tmp_path / "x" / "part.txt").write_bytes(data)
        found = warc.resolve(warc.captures(warc.read(spark, str(tmp_path / "x"))))
        columns = ["verified", "payload_bytes", "payload_sha1", warc.metadata_field("page-id", "target.metadata").alias("target"), F.col("request").isNotNull().alias("asked")]
        return {int(r.page): r for r in found.select(warc.metadata_field("page-id").alias("page"), "kind", *columns).collect()}

    good = answers(whole)
    assert [(good[i].kind, good[i].target, good[i].verified, good[i].payload_bytes) for i in (1, 2, 3, 4)] == [("revisit", "3", True, 2003), ("revisit", "3", True, 2003), ("response", None, True, 2003), ("response", None, True, 1500)]
    assert good[1].payload_sha1 == hashlib.sha1(big.encode()).hexdigest() and all(r.asked for r in good.values())
    bad = answers(whole.replace(b"yyyy", b"yyyx", 1))  # a damaged payload: its page and what refers to it
    assert [bad[i].verified for i in (1, 2, 3, 4)] == [False, False, False, True] and bad[3].payload_sha1 != good[3].payload_sha1
    name = re.search(rb"WARC-Refers-To: (<[^>]*>)", whole)[1]
    lost = answers(whole.replace(b"WARC-Refers-To: " + name, b"WARC-Refers-To: " + name[:-3] + b"00>", 1))
    assert sorted((r.kind, r.target, r.verified) for r in lost.values() if r.kind == "revisit" and not r.verified) == [("revisit", None, False)]
    alone = answers(re.sub(rb"WARC-Concurrent-To: <urn", b"WARC-Concurrent-To: <xrn", whole, count=1))
    assert sum(not r.asked for r in alone.values()) == 1


def test_html_structure_and_suffix_array(spark):
    page = html.Page('<body><div id="cookie-notice">c</div><nav>n</nav><main><h1>T &lt; x</h1><p>a<b>b</b>c<br>d &nbsp; e<p>two<!-- x --><ul><li>one<li>2</ul><div class="comments">r</div><form>f</form><script>var a="</p>";</script></main><aside>s</aside><footer>z</footer>')
    assert [t for t, _ in page.parts()[0]] == ["T < x", "abc d e", "two", "one", "2"]
    menu = "home news sport weather travel food music film"
    rows = [(i, f"http://h.org/{i}", f"<div>{menu}</div><div>{prose(i, 30)}</div>") for i in range(5)]
    rows += [(10, "http://other.org/", f"<div>{menu}</div>"), (11, None, None), (12, "http://h.org/x", ""), (13, "http://h.org/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("h", "t", "text", "covered")})
    found = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert all(found[i] == prose(i, 30) for i in range(5)) and found[13] == found[0]
    assert found[10] == menu and found[11] == found[12] == ""
    assert html.extract(pages.limit(0)).count() == 0


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 50, 300):
        for letters in (1, 2, 5, 1000):
            stream = rng.integers(0, letters, n).astype(np.uint64)
            plain = sorted(range(n), key=lambda i: stream[i:].tolist())
            order, lcp = html.suffix_array(stream)
            assert order.tolist() == plain
            common = [sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(stream[a:], stream[b:], strict=False))) for a, b in itertools.pairwise(plain)]
            assert lcp.tolist()[1:] == common


@pytest.mark.parametrize("shard_tokens", [150, 10**6])
def test_repeats_against_brute_force(spark, shard_tokens):
    """Open text loses exactly the places of 8-token runs on three or more distinct pages of its host; shards change nothing."""
    rng, rows = np.random.default_rng(6), []
    common = [prose(70 + i, 6 + 5 * i) for i in range(4)]
    for i in range(40):
        blocks = [prose(i * 10 + j, int(rng.integers(1, 25))) for j in range(3)] + [common[k] for k in rng.integers(0, 4, 3)]
        rows.append((i, f"https://h{i % 3}.org/{i}", "".join(f"<p>{blocks[k]}</p>" for k in rng.permutation(6))))
    rows += [(40, "https://h0.org/x", rows[0][2]), (41, "https://one.org/", rows[1][2])]
    runs: dict = {}
    for i, url, source in rows[:40] + rows[41:]:
        stream = [t for b in re.findall("<p>(.*?)</p>", source) for t in html.padded(b.split())]
        for at in range(len(stream) - 7):
            runs.setdefault((url.split("/")[2], *stream[at : at + 8]), set()).add(i)
    expected = {}
    for i, url, source in rows:
        stream = [t for b in re.findall("<p>(.*?)</p>", source) for t in html.padded(b.split())]
        gone = {at + j for at in range(len(stream) - 7) if len(runs[(url.split("/")[2], *stream[at : at + 8])]) >= 3 for j in range(8)}
        kept, at = [], 0
        for b in re.findall("<p>(.*?)</p>", source):
            kept.append(" ".join(t for j, t in enumerate(b.split(), at) if j not in gone))
            at += len(html.padded(b.split()))
        expected[i] = "\n\n".join(x for x in kept if x)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(pages, shard_tokens=shard_tokens).collect()} == expected


def test_hints_within_an_article_are_left_to_the_suffix_array(spark):
    legal = "terms apply to all offers shown on this page today"
    rows = [(i, "http://h.org/" + str(i), f'<article><p>{prose(i, 20)}</p><p class="legal">{legal}</p><p class="share">Share this</p><p class="notice">{prose(90 + i, 9)}</p><div class="comments">{prose(50 + i, 9)}</div></article>') for i in range(4)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: prose(i, 20) + "\n\n" + prose(90 + i, 9) for i in range(4)}


def test_raw_elements_cost_linear_time():
    def seconds(n: int) -> float:
        source = "<article>" + "<p>x</p><script>var a = '<p>';</script>" * n + "<svg>" * n + "</article>"
        began = time.perf_counter()
        assert len(html.Page(source).parts()[0]) >= n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 40 * max(seconds(800), 0.005)


def test_licences():
    m = licences.Matcher(licences.TEMPLATES, 0.8)
    assert m.matches("intro\nReleased under the MIT License.\nmore") == {"mit-notice": 1.0}
    assert max(m.matches("x\n\n" + licences.TEMPLATES["mit"].replace("Software", "software")).items(), key=lambda x: x[1])[0] == "mit"
    assert m.matches(None) == {} and m.matches("") == {} and m.matches(prose(1, 5000)) == {}


def test_search_against_brute_force(spark):
    rows = [(i, prose(i, 30 + i)) for i in range(150)] + [(200, None), (201, ""), (202, prose(3, 33)), (203, prose(3, 33))]
    found = search.top_k(docs(spark, rows), docs(spark, [r for r in rows if r[0] % 50 == 0]), k=5, shard_docs=40).collect()
    bags = {k: Counter((t or "").split()) for k, t in rows}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    expected = {}
    for q in (k for k in bags if k % 50 == 0 and bags[k]):
        scores = {}
        for k, b in bags.items():
            s = sum(np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in bags[q] if w in b)
            if s > 0:
                scores[k] = round(float(s), 6)
        expected[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert {q: [k for k, _ in v] for q, v in got.items()} == {q: [k for k, _ in v] for q, v in expected.items()}


def test_articles_beside_the_main_text(spark):
    body, teaser = prose(1, 60), prose(2, 8)
    pages = {
        1: f"<main><p>{body}</p><article class='card'><p>{teaser}</p></article></main>", 2: f"<main><h2>{teaser}</h2><article><p>{body}</p></article></main>",
        3: f"<div>{teaser}</div><main><p>{body}</p></main>", 4: f"<p>{body}</p>",
    }
    rows = spark.createDataFrame([(k, f"http://h{k}.example/", v) for k, v in pages.items()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(rows).collect()} == dict.fromkeys(pages, body)


def test_malformed_archives(spark, tmp_path):
    """Broken members and records are rows with a reason; what is around them is read."""
    def record(n: int, length: str | None = None) -> bytes:
        block = f"HTTP/1.1 200 OK\r\n\r\nbody {n} WARC/1.0 inside".encode()
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{n}>\r\nContent-Type: application/http\r\n"
        return head.encode() + (f"Content-Length: {len(block) if length is None else length}\r\n" if length != "" else "").encode() + b"\r\n" + block + b"\r\n\r\n"

    whole = [gzip.compress(record(n)) for n in range(4)]
    broken = bytearray(gzip.compress(record(9)))
    broken[14] ^= 0xFF
    (tmp_path / "a.txt").write_bytes(whole[0] + bytes(broken) + whole[1])
    (tmp_path / "b.txt").write_bytes(whole[2] + b"no gzip at all" + whole[3] + gzip.compress(record(5))[:-20])
    (tmp_path / "c.txt").write_bytes(b"junk " + record(6) + b"more junk" + record(7, "x") + record(8, "") + record(10))
    (tmp_path / "d.txt").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(record(11)[:20])
    found = warc.read(spark, str(tmp_path)).collect()
    bodies = {r.record_id: r.payload for r in found if r.kind == "response"}
    assert {k for k in bodies} >= {f"<{n}>" for n in (0, 1, 2, 3, 6, 10)} and not {"<7>", "<8>", "<11>"} & set(bodies)
    assert all(bodies[f"<{n}>"] == f"body {n} WARC/1.0 inside".encode() for n in (0, 1, 2, 3, 6, 10))
    errors = [r.head for r in found if r.kind == "error"]
    assert len(errors) >= 7 and all(r.payload is None and r.payload_sha1 is None for r in found if r.kind == "error")
    for reason in ("member at byte", "ends early", "no record at byte 0", "no length in the record"):
        assert any(reason in e for e in errors), reason
    assert {r.kind for r in warc.captures(warc.read(spark, str(tmp_path))).collect()} == {"response"}


def test_quality_and_gumbel(spark):
    noisy = lambda i: " ".join(w + "%%%" for w in prose(i, 60).split())
    good, raw = [(i, prose(i, 60)) for i in range(80)], [(i, prose(500 + i, 60)) for i in range(300)] + [(600 + i, noisy(i)) for i in range(60)]
    model = quality.fit(docs(spark, raw), docs(spark, good), share=0.8)
    fresh = docs(spark, [(1, prose(901, 50)), (2, noisy(902)), (3, None), (4, "one"), (5, ""), (6, prose(901, 5000))])
    r = {x.doc_id: x for x in quality.resample(fresh, model).collect()}
    assert r[1].selected and r[6].selected and not r[2].selected and not r[3].selected and not r[5].selected
    assert r[2].log_weight < -5 < 0 < r[1].log_weight and r[4].n_grams == 1
    # Both models from plain counts, and a long text's weight as the plain ratio of its likelihoods under them.
    counts = lambda rows: Counter(int(b) for _, t in rows for b in quality.Features().buckets(t))
    own, every = counts(good), counts(raw)
    scale = sum(own.values()) / sum(every.values())
    for k, t in ((1, prose(901, 50)), (2, noisy(902)), (6, prose(901, 5000))):
        ratio = sum(np.log((own[int(b)] + 50.0) / (every[int(b)] * scale + 50.0)) for b in quality.Features().buckets(t))
        assert abs(r[k].log_weight - ratio) < 1e-6 * max(1, abs(ratio)), k
    # The definition, in plain Python: the k greatest of log weight plus noise; and that is not a threshold on the weight.
    features, plain = quality.Features(), []
    noise = dict(docs(spark, raw).select("doc_id", quality._noise("doc_id", "text")).collect())
    for i, t in raw:
        w, n = model.weight(features, t)
        assert n == 4 * len(quality._TOKEN.findall(t)) - 3
        plain.append((w + quality.gumbel(noise[i]), w, i))
    found = quality.resample(docs(spark, raw), model, k=100).filter("selected").collect()
    assert {x.doc_id for x in found} == {i for _, _, i in sorted(plain)[-100:]} != {i for _, _, i in sorted(plain, key=lambda x: x[1])[-100:]}
    kept = quality.keep_selected(docs(spark, raw), model)
    ids = {x.doc_id for x in kept.collect()}
    assert kept.columns == docs(spark, raw).columns and len(ids) == round(sum(model.posterior(w) for _, w, _ in plain))
    assert len(ids & {i for i, _ in raw[:300]}) > 290 and not ids & {600 + i for i in range(60)}
    flat = quality.Model(np.zeros(quality.BUCKETS), 1.0)
    assert quality.keep_selected(docs(spark, raw), flat).count() == len(raw) and quality.keep_selected(docs(spark, []), model).count() == 0
    shares = np.mean([np.argmax([np.log(p) + quality.gumbel(int(z)) for p, z in zip((0.2, 0.3, 0.5), zs, strict=True)]) == 2 for zs in np.random.default_rng(2).integers(0, 1 << 60, (4000, 3))])
    assert abs(shares - 0.5) < 0.03
    values = spark.createDataFrame([(float(v),) for v in [5, 1, 9, 9, 3, -4, 1e9, -1e9]], "v double")
    assert [quality.kth_greatest(values, "v", k) for k in (1, 2, 3, 5, 8)] == [1e9, 9.0, 9.0, 3.0, -1e9]


@pytest.mark.parametrize("query_terms", [40, 10**6])
def test_search_blocks(spark, query_terms):
    """Blocks of queries and shards change nothing; queries without a known word get no rows; equal rows and ids are ranked each."""
    rows = [(i, prose(i, 20)) for i in range(90)] + [(90, prose(3, 20)), (90, prose(3, 20))]
    asked = [(1, prose(3, 20)), (2, "unheard of"), (3, None), (4, prose(5, 10)), (4, prose(6, 10)), (5, prose(7, 400))]
    table = spark.createDataFrame(asked, "doc_id long, text string")
    found = search.top_k(docs(spark, rows).repartition(3), table, k=4, shard_docs=7, query_terms=query_terms).collect()
    whole = search.top_k(docs(spark, rows).coalesce(1), table, k=4).collect()
    assert sorted(found) == sorted(whole) and {r.query_id for r in found} == {1, 4, 5}
    assert [r.doc_id for r in sorted(found) if r.query_id == 1][:3] == [3, 90, 90]
    assert search.top_k(docs(spark, rows), table.filter("doc_id = 2"), k=4).count() == 0
