"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, html, langid, layers, licences, minhash, packing, quality, search, sharding, toxicity, trie, warc
from quillspark.llm.folds import bounded_sample, held_out
from quillspark.plans.session import table
from quillspark.plans.storage import materialize, new_path

TOKENIZER = "word_bpe_49k.json"


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.filter(F.col("doc_id") % 100 == 0), k=10)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_records`` are the records of the transaction; ``verified`` that claimed digest and payload agree."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    # Payloads are digested where archives are read, which happens once.
    found = materialize(warc.read(spark, path).drop("payload"), "records")
    found = warc.resolve(warc.captures(found))
    return found.select(
        warc.metadata_field("page-id").cast("long").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("kind").alias("record_type"),
        warc.metadata_field("page-id", "target.metadata").cast("long").alias("refers_to"),
        (1 + F.col("request").isNotNull().cast("long") + F.col("metadata").isNotNull().cast("long")).alias("n_records"), "verified",
    )


#: Labelled rows that a classifier is fitted on, at most (about); all labelled rows of the training fold if they are fewer.
LABELLED_ROWS = 20_000


def training_rows(docs: DataFrame, labels: DataFrame, label) -> DataFrame:
    """(doc_id, text, _l_label) of a bounded sample of labelled rows outside the held-out fold.

    The sample is taken from the labels, so that it can be broadcast and no text is shuffled.
    """
    marks = labels.groupBy(F.col("doc_id").alias("_l_id")).agg(label.alias("_l_label")).filter(~held_out(F.col("_l_id")) & F.col("_l_label").isNotNull())
    sample = F.broadcast(bounded_sample(marks, "_l_id", LABELLED_ROWS))
    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_l_id"))
    return materialize(rows.select("doc_id", "text", "_l_label"), "training")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learnt from labelled rows. Repeated labels of an id: toxic if one of them is."""
    return toxicity.fit(training_rows(docs, labels, F.max("toxic")), "doc_id", "text", "_l_label")


def op5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).select("doc_id", "licence", "dice", "n_licences")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Target text is labelled 1, raw text is every document; the expected share of target text is that among the labelled.

    Repeated labels of an id: not target if one of them is 0.
    """
    train = training_rows(docs, labels, F.min("quality"))
    good, n = train.agg(F.count_if(F.col("_l_label") > 0), F.count("*")).first()
    return quality.fit(docs, train.filter(F.col("_l_label") > 0), "text", share=(good + 1) / (n + 2))


def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.resample(docs, model).select("doc_id", "log_weight", "n_grams", "key", "selected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return packing.pack(table(spark, sf_dir, "documents"), path, with_ids=False)


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers.offers(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "sales"), table(spark, sf_dir, "items"))
    return layers.pareto_layers(found, "part_type", lower=["price", "delay"], higher=["discount", "quantity"], most=24)


def op12_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"), every=20, heads=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_block_max": op2_block_max,
    "op3_mixture": op3_mixture,
    "op4_transactions": op4_transactions,
    "op5_segments": op5_segments,
    "op6_winnowing": op6_winnowing,
    "op7_dice": op7_dice,
    "op8_minhash": op8_minhash,
    "op9_resampling": op9_resampling,
    "op10_packing": op10_packing,
    "op11_lattice": op11_lattice,
    "op12_minimax": op12_minimax,
    "op13_prefix_trie": op13_prefix_trie,
}

_SQL_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licences.TEMPLATES.items())

ORACLE_SQL: dict[str, str] = {
    "op2_block_max": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM d),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
scored AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))), 6) AS score
  FROM (SELECT doc_id, term FROM t WHERE doc_id % 100 = 0) q JOIN t USING (term) JOIN f USING (term) JOIN d ON d.doc_id = t.doc_id, s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op7_dice": rf"""
WITH tpl(name, body) AS (VALUES {_SQL_TEMPLATES}),
unit AS (SELECT DISTINCT doc_id, u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents UNION ALL
  SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM documents UNION ALL SELECT doc_id, text FROM documents) WHERE u IS NOT NULL),
own AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY doc_id, u) AS uid, u FROM unit UNION ALL SELECT 't', name, 0, body FROM tpl),
word AS (SELECT kind, id, uid, regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM own),
gram AS (SELECT DISTINCT kind, id, uid, w[i] || ' ' || w[i + 1] AS g FROM (SELECT kind, id, uid, w, unnest(range(1, len(w))) AS i FROM word)),
size AS (SELECT kind, id, uid, count(*) AS n FROM gram GROUP BY ALL),
dice AS (SELECT a.id, b.id AS name, 2.0::DOUBLE * count(*) / (any_value(x.n) + any_value(y.n)) AS dice
  FROM gram a JOIN gram b ON a.g = b.g AND a.kind = 'd' AND b.kind = 't' JOIN size x ON x.kind = 'd' AND x.uid = a.uid AND x.id = a.id JOIN size y ON y.kind = 't' AND y.id = b.id GROUP BY a.id, a.uid, b.id),
best AS (SELECT id, name, max(dice) AS dice FROM dice WHERE dice >= 0.8 GROUP BY id, name),
top AS (SELECT id, name, dice, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY dice DESC, name) AS r FROM best)
SELECT doc_id, name AS licence, coalesce(dice, 0.0::DOUBLE) AS dice, CAST(coalesce(n, 0) AS BIGINT) AS n_licences
FROM documents LEFT JOIN top ON top.id = CAST(doc_id AS VARCHAR) AND r = 1""",
    "op4_transactions": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to, CAST(3 AS BIGINT) AS n_records, TRUE AS verified
FROM p LEFT JOIN g ON p.h = g.h AND p.n = g.n""",
    "op11_lattice": r"""
WITH RECURSIVE l AS (SELECT item_id, vendor_id, kind, CAST(quantity AS BIGINT) AS q, CAST(floor(100 * amount + 0.5) AS BIGINT) AS c, CAST(floor(100 * discount + 0.5) AS BIGINT) AS d,
  CAST(floor(100 * price + 0.5) AS BIGINT) AS p, date_diff('day', CAST(sold_at AS DATE), CAST(shipped_at AS DATE)) AS days
  FROM sale_lines LEFT JOIN sales USING (sale_id) LEFT JOIN items USING (item_id) WHERE item_id IS NOT NULL AND vendor_id IS NOT NULL),
s AS (SELECT item_id, vendor_id, any_value(kind) AS part_type, any_value(p) AS p, sum(c * (100 - d)) FILTER (q IS NOT NULL) AS paid, sum(q) FILTER (c IS NOT NULL AND d IS NOT NULL) AS pieces,
  sum(d) AS d, count(d) AS n_d, sum(days) AS days, count(days) AS n_days, max(q) AS quantity FROM l GROUP BY ALL),
o AS (SELECT item_id, vendor_id, part_type, CASE WHEN p >= 1 THEN CAST((paid - ((paid % (p * pieces)) + p * pieces) % (p * pieces)) // (p * pieces) AS BIGINT) END AS price,
  CAST((d - ((d % n_d) + n_d) % n_d) // n_d AS BIGINT) AS discount, CAST((days - ((days % n_days) + n_days) % n_days) // n_days AS BIGINT) AS delay, quantity FROM s),
k AS (SELECT *, coalesce('t' || part_type, 'none') AS grp, coalesce(price, 1000000000000) AS a, coalesce(delay, 1000000000000) AS b, coalesce(-discount, 1000000000000) AS c, coalesce(-quantity, 1000000000000) AS e FROM o),
r(grp, a, b, c, e, layer) AS (SELECT DISTINCT grp, a, b, c, e, 1 FROM k UNION ALL SELECT DISTINCT 'all', a, b, c, e, 1 FROM k UNION ALL
  SELECT grp, a, b, c, e, layer + 1 FROM r AS y WHERE layer <= 24 AND EXISTS (SELECT 1 FROM r AS x WHERE x.grp = y.grp AND x.a <= y.a AND x.b <= y.b AND x.c <= y.c AND x.e <= y.e AND (x.a < y.a OR x.b < y.b OR x.c < y.c OR x.e < y.e))),
t AS (SELECT grp, a, b, c, e, CAST(CASE WHEN max(layer) <= 24 THEN max(layer) ELSE 0 END AS BIGINT) AS layer FROM r GROUP BY ALL)
SELECT item_id, vendor_id, part_type, price, discount, delay, quantity, t.layer AS type_layer, g.layer AS global_layer, count(*) OVER (PARTITION BY a, b, c, e) AS n_equal
FROM k JOIN t USING (grp, a, b, c, e) JOIN t AS g USING (a, b, c, e) WHERE g.grp = 'all'""",
    "op12_minimax": r"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, min(doc_id) AS leader, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY text),
big AS (SELECT *, row_number() OVER w - 1 AS i, size * (24 - (row_number() OVER w - 1)) >= sum(size) OVER () - sum(size) OVER w + size AS large FROM g WINDOW w AS (ORDER BY size DESC, leader ROWS UNBOUNDED PRECEDING)),
own AS (SELECT text, i FROM (SELECT *, bool_and(large) OVER (ORDER BY i) AS alone FROM big) WHERE alone AND i < 24),
m AS (SELECT count(*) AS m FROM own),
e AS (SELECT text, leader, size, CAST(sum(size) OVER (ORDER BY leader ROWS UNBOUNDED PRECEDING) AS BIGINT) AS place FROM g WHERE text NOT IN (SELECT text FROM own)),
z AS (SELECT CAST(24 - m AS BIGINT) AS s, CAST(coalesce((SELECT max(place) FROM e), 0) AS BIGINT) AS total, CAST(coalesce((SELECT max(size) FROM e), 0) AS BIGINT) AS largest FROM m),
p AS (SELECT place FROM e UNION ALL SELECT 0),
search(lo, hi, pos, k) AS (SELECT greatest(largest, (total + s - 1) // s), total, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM z WHERE total > 0 UNION ALL
  SELECT CASE WHEN pos < total AND k = s THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN pos = total THEN (lo + hi) // 2 ELSE hi END,
         CASE WHEN pos = total OR k = s THEN 0 ELSE (SELECT max(place) FROM p WHERE place <= pos + (lo + hi) // 2) END, CASE WHEN pos = total OR k = s THEN 0 ELSE k + 1 END FROM search, z WHERE lo < hi),
c AS (SELECT min(lo) AS c FROM search WHERE lo = hi),
early(j, pos) AS (SELECT s, total FROM z UNION ALL SELECT j - 1, (SELECT min(place) FROM p WHERE place >= pos - c) FROM early, c WHERE j > 1),
cut(j, pos) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
  SELECT j + 1, greatest(CASE WHEN over <= pos + c AND over - share < share - under THEN over ELSE under END, need) FROM (
    SELECT *, (SELECT max(place) FROM p WHERE place <= least(share, pos + c)) AS under, (SELECT min(place) FROM p WHERE place >= share) AS over, (SELECT early.pos FROM early WHERE early.j = y.j + 1) AS need
    FROM (SELECT j, pos, c, pos + (total - pos) // (s - j) AS share FROM cut, z, c WHERE j + 1 < s) AS y)),
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
place AS (SELECT text, leader, m + (SELECT count(*) FROM cut WHERE j > 0 AND cut.pos < e.place) AS shard FROM e, m UNION ALL SELECT own.text, leader, i FROM own JOIN g USING (text))
SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY leader, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN place USING (text), crc_table""",
    "op13_prefix_trie": r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
ids AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda b: CAST('0x' || b AS BIGINT))),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table),
o AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations GROUP BY conv_id),
w AS (SELECT c, list_concat(coalesce(b.t[1 : h], []), own.t[h + 1 :]) AS t FROM ids JOIN o AS own ON own.conv_id = c LEFT JOIN o AS b ON b.conv_id = base),
p AS (SELECT c, d, t[1 : d] AS k, len(t) AS n FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM w)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY k, d),
kid AS (SELECT k[1 : d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kid.n, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node.k[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM node LEFT JOIN kid USING (k)),
sub AS (SELECT k, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT k[1 : a] AS k, saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_)) GROUP BY k)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ AS f JOIN sub USING (k) LEFT JOIN node AS up ON f.d > 0 AND up.k = f.k[1 : f.d - 1]""",
    "op6_winnowing": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[s : s + 9], ' ') AS win, least(len(w), 10) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op8_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.doc_id)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id""",
}
