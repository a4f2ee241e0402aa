"""Sources: caption files, listings, logs and batch outputs as DataFrames."""

from __future__ import annotations

import html
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X
from quillspark.plans.storage import materialize

CAPTION_EVENTS = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string,tOffsetMs:bigint>>>>>"


def json3_cues(files: DataFrame, content: str, *keep: str) -> DataFrame:
    """(keep.., start_s, end_s, text): one row per caption event with text; pieces joined, line feeds as blanks."""
    events = files.select(*keep, F.explode(F.from_json(content, CAPTION_EVENTS)["events"]).alias("e"))
    text = X.collapse(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.col("e.tStartMs") / 1000
    return events.select(*keep, start.alias("start_s"), (start + F.coalesce("e.dDurationMs", F.lit(0)) / 1000).alias("end_s"), text.alias("text")).filter("text <> ''")


def json3_words(files: DataFrame, content: str, *keep: str) -> DataFrame:
    """(keep.., t_s, word): each piece at its absolute time, bracketed tags dropped."""
    events = files.select(*keep, F.explode(F.from_json(content, CAPTION_EVENTS)["events"]).alias("e"))
    words = events.select(*keep, "e.tStartMs", F.explode("e.segs").alias("s"))
    word = X.collapse(F.col("s.utf8"))
    return words.select(*keep, ((F.col("tStartMs") + F.coalesce("s.tOffsetMs", F.lit(0))) / 1000).alias("t_s"), word.alias("word")).filter((word != "") & ~word.startswith("["))


def clock_seconds(text: Column) -> Column:
    """Seconds of H:M:S.f, M:S.f or S.f."""
    parts = F.reverse(F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":"))
    values = F.transform(parts, lambda p, i: p.try_cast("double") * F.pow(F.lit(60.0), i))
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def html_unescape(text: Column) -> Column:
    """All character references, named and numbered."""
    return F.when(F.contains(text, F.lit("&")), _unescaped(text)).otherwise(text)


def vtt_cues(files: DataFrame, content: str, *keep: str) -> DataFrame:
    """(keep.., start_s, end_s, text) of the blocks with an arrow line; tags stripped."""
    blocks = files.select(*keep, F.explode(F.split(F.regexp_replace(content, "\r", ""), "\n\n+")).alias("b")).filter(F.col("b").contains("-->"))
    line = F.regexp_extract("b", r"(?m)^(\S+)\s+-->\s+(\S+)", 0)
    start, end = F.split(line, r"\s+-->\s+")[0], F.split(line, r"\s+-->\s+")[1]
    body = F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)$", 1), "<[^>]*>", "")
    return blocks.select(*keep, clock_seconds(start).alias("start_s"), clock_seconds(end).alias("end_s"), X.collapse(html_unescape(body)).alias("text")).filter("text <> ''")


def hrefs(html: Column, pattern: str = r'href="([^"]*)"') -> Column:
    """Distinct link targets in order of their names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))))


def directory_listing(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """(keep.., name, href, size_bytes): file anchors of a listing, with the size that follows them."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)<a[^>]*href="[^"?]+"[^>]*>[^<]*</a>[^<]*(?:<span[^>]*>[^<]*</span>)?'), F.lit(0))
    rows = pages.select(*keep, F.explode(found).alias("a"))
    size = F.regexp_extract("a", r"([0-9.]+\s*[KMG]?B)", 1)
    return rows.select(*keep, html_unescape(F.regexp_extract("a", r">([^<]*)</a>", 1)).alias("name"), F.regexp_extract("a", r'href="([^"]+)"', 1).alias("href"), X.parse_size(size).alias("size_bytes"))


def walk_listings(pages: DataFrame, url: str, html: str, start: str) -> DataFrame:
    """(url, depth): listings reachable from ``start`` through ?dir= links; each round joins the newly found with the pages,
    until none is new."""
    links = pages.select(F.col(url).alias("at"), F.explode(F.regexp_extract_all(html, F.lit(r'href="\?dir=([^"]+)"'), F.lit(1))).alias("dir"))
    links = links.select("at", F.try_url_decode("dir").alias("to")).distinct().cache()
    seen = pages.sparkSession.createDataFrame([(start, 0)], "url string, depth int")
    new = seen
    for depth in count(1):
        new = new.join(links, F.col("url") == F.col("at")).select(F.col("to").alias("url")).distinct()
        new = materialize(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "listings")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if depth % 20 == 0:  # keeps the plan short
            seen = materialize(seen, "listings")
    return seen


def embedded_json(html: Column, marker: str = "__NEXT_DATA__") -> Column:
    """The JSON text of a page's script element with this id; null if there is none."""
    value = F.regexp_extract(html, rf'(?s)<script[^>]*id="{marker}"[^>]*>(.*?)</script>', 1)
    return F.when(value != "", value)


@F.udtf(returnType=T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "url")]))
class JsonObjects:
    """All objects with an id and a url anywhere in a JSON text, in the order of a depth-first walk."""

    def eval(self, text: str):
        import json

        try:
            stack = [json.loads(text)] if text else []
        except ValueError:
            return
        seen = set()
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                key = node.get("id")
                if key is not None and node.get("url") and key not in seen:
                    seen.add(key)
                    yield str(key), node.get("title"), str(node["url"])
                stack.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                stack.extend(reversed(node))


def playlist_fields(line: Column) -> Column:
    """Struct (id, title, seconds) of 'id|title|duration'; an unreadable duration is 0."""
    parts = F.split(line, r"\|", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("title"), F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)).alias("seconds"))


def manifest_tree(spark: SparkSession, root: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """All <root>/<session>/manifest.jsonl: rows with their session from the folder's name; blank lines are skipped.

    A line that is no JSON of the schema raises when it is read.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/*/manifest.jsonl").withColumn("session", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/manifest\.jsonl", 1))
    return rows.fillna(defaults) if defaults else rows


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def jsonl_directory(spark: SparkSession, root: str, schema: str, name: str = "item") -> DataFrame:
    """Rows of all <root>/*.jsonl, with the file's name (without extension) in column ``name``."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/*.jsonl")
    return rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.jsonl$", 1))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header and a stated schema; quoted fields may hold line feeds."""
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').option("mode", "FAILFAST").csv(path)


def first_existing(rows: DataFrame, id_: str, candidates: Column, listing: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with ``found``: the first of the ``candidates`` (an array, in order of preference) that ``listing`` holds, or null.

    Repeated ids share what any of them finds first; a null id finds nothing.
    """
    tried = rows.select(id_, F.posexplode(candidates).alias("_i", path)).join(listing.select(path).distinct(), path, "left_semi")
    best = tried.groupBy(id_).agg(F.min(F.struct("_i", path))[path].alias("found"))
    return rows.join(best, id_, "left")


def missing_ids(asked: DataFrame, answered: DataFrame, id_: str, **fill: Column) -> DataFrame:
    """``answered`` and a row for every asked id without an answer, its columns filled as stated (null if not)."""
    gone = asked.select(id_).distinct().join(answered.select(id_), id_, "left_anti")
    kinds = {f.name: f.dataType for f in answered.schema.fields}
    columns = [F.col(id_) if c == id_ else fill.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in answered.columns]
    return answered.unionByName(gone.select(*columns))


def log_events(lines: DataFrame, line: str, pattern: str, fields: tuple[str, ...]) -> DataFrame:
    """Lines that match, with the pattern's groups as columns."""
    return lines.filter(F.col(line).rlike(pattern)).select("*", *[F.regexp_extract(line, pattern, i).alias(f) for i, f in enumerate(fields, 1)])


def sectioned_log(lines: DataFrame, key: str, order: str, line: str, head: str) -> DataFrame:
    """``section``: the number of head lines up to each line, per key; lines before the first head are section 0."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.col(line).rlike(head).cast("int")).over(w))


def batch_outputs(lines: DataFrame, line: str, path: str = "response.body.choices[0].message.content", items: str = "array<struct<id:string,text:string,verdict:string>>", list_field: str = "results") -> tuple[DataFrame, DataFrame]:
    """(results, errors) of batch-output lines: a JSON text within JSON at ``path``; lines without readable items are errors."""
    body = F.get_json_object(line, f"$.{path}")
    parsed = F.from_json(body, f"struct<{list_field}:{items}>")[list_field]
    rows = lines.select(F.get_json_object(line, "$.custom_id").alias("custom_id"), parsed.alias("items"), F.get_json_object(line, "$.error").alias("error"))
    good = rows.filter("items IS NOT NULL").select("custom_id", F.explode("items").alias("i")).select("custom_id", "i.*")
    return good, rows.filter("items IS NULL").select("custom_id", "error")
