"""Blocks to Markdown, content lists and files; the result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_HOURS = 24
#: More pages than any document has; a range that asks for more is an error.
MOST_PAGES = 100_000


def block_markdown() -> Column:
    """Of a row with category, text, html, latex, asset_path: html, else display maths, else text, else the asset."""
    text = F.when(F.col("category") == "title", F.concat(F.lit("# "), F.col("text"))).when(F.col("category") == "list", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    maths = F.concat(F.lit("$$\n"), F.col("latex"), F.lit("\n$$"))
    image = F.concat(F.lit("![]("), F.col("asset_path"), F.lit(")"))
    return F.coalesce("html", maths, text, image)


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): blocks by page and reading order, an empty line between."""
    md = blocks.withColumn("_md", block_markdown()).where("_md IS NOT NULL")
    got = md.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "reading_order", "_md"))).alias("b"))
    return got.select("doc_id", F.regexp_replace(F.array_join(F.transform("b", lambda x: x["_md"]), "\n\n"), r"\s+$", "").alias("markdown"))


def content_list(blocks: DataFrame) -> DataFrame:
    """(doc_id, content): a JSON list of the blocks in order."""
    item = F.struct("page", "reading_order", F.to_json(F.struct(F.col("page").alias("page_num"), "category", "text", "html", "latex", "asset_path")).alias("j"))
    got = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("b"))
    return got.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("b", lambda x: x["j"]), ","), F.lit("]")).alias("content"))


def cache_key(content: Column, protocol: Column, endpoint: Column, model: Column) -> Column:
    """SHA-256 of bytes, a zero byte and the parameters."""
    params = F.concat_ws("|", protocol, F.coalesce(endpoint, F.lit("")), F.coalesce(model, F.lit("")))
    return F.sha2(F.concat(content, F.unhex(F.lit("00")), F.encode(params, "UTF-8")), 256)


def not_cached(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests (key, ...) that no cache row (key, stored_at) of the last CACHE_HOURS answers."""
    fresh = cache.where((now - F.col("stored_at")) <= CACHE_HOURS * 3600).select(F.col("key").alias("_key"))
    return requests.join(fresh, F.col("key") == F.col("_key"), "left_anti")


def distinct_assets(assets: DataFrame) -> DataFrame:
    """(sha256, path, bytes, uses) of assets (media_type, content): each content once, under its hash."""
    ext = F.create_map(*[F.lit(x) for p in (("image/png", "png"), ("image/jpeg", "jpg"), ("image/gif", "gif"), ("image/svg+xml", "svg"), ("image/webp", "webp")) for x in p])
    hashed = assets.withColumn("sha256", F.sha2("content", 256))
    return hashed.groupBy("sha256").agg(
        F.concat(F.col("sha256"), F.lit("."), F.coalesce(F.try_element_at(ext, F.min("media_type")), F.lit("bin"))).alias("path"), F.max(F.octet_length("content")).alias("bytes"), F.count("*").alias("uses")
    )


def page_range(spec: Column, most: int = MOST_PAGES) -> Column:
    """Sorted distinct pages of "1,3-5"; null where page_range_error() has an error."""
    low, high = _range_ends()
    pages = F.transform(_range_parts(spec), lambda p: F.sequence(low(p), high(p)))
    return F.when(page_range_error(spec, most).isNull() & spec.isNotNull(), F.array_sort(F.array_distinct(F.flatten(pages))))


def _range_parts(spec: Column) -> Column:
    return F.transform(F.split(spec, ","), lambda p: F.regexp_replace(p, r"\s", ""))


def _range_ends():
    return lambda p: F.split(p, "-")[0].cast("int"), lambda p: F.element_at(F.split(p, "-"), -1).cast("int")


def page_range_error(spec: Column, most: int = MOST_PAGES) -> Column:
    """malformed, zero, descending, too many (more than most pages asked for), or null; nothing is expanded for it."""
    parts = _range_parts(spec)
    low, high = _range_ends()
    fine = F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}(-[0-9]{1,9})?$"))
    asked = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + high(p) - low(p) + 1)
    sane = F.when(F.exists(parts, lambda p: low(p) == 0), "zero").when(F.exists(parts, lambda p: low(p) > high(p)), "descending").when(asked > most, "too many")
    return F.when(spec.isNotNull(), F.when(~fine, "malformed").otherwise(sane))


def cache_stats(cache: DataFrame) -> DataFrame:
    """(entries, total_bytes) of a cache table (key, body, ...)."""
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("total_bytes"))


def data_url(png: Column) -> Column:
    """Bytes of a PNG file as a URL of its own."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"[\r\n]", ""))
