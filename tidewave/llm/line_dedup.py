"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

A line that stands on more than a given share of a site's pages is boilerplate there, and is dropped from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewave.llm.store import counted, keyed_join, written

#: Hashes of boilerplate lines that may be broadcast; beyond it, the join shuffles.
BROADCAST_LINES = 200_000
#: Pages of a site that share a copy of its lines where the join shuffles.
PAGES = 50_000
#: Pages of a site that a line stands on at least, by default: the ratio decides, and neither one page nor a page and its copy make boilerplate.
LEAST = 3
#: Fixed patterns of HTML: what is not text, elements that end a line, other tags, and characters written by name.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>"
BLOCKS = r"(?i)</?(?:html|head|title|body|header|footer|nav|main|article|section|aside|div|p|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|td|th|pre|blockquote|form)\b[^>]*>"
TAGS = r"</?[A-Za-z][^>]*>"
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_BLANK = " \t\r\x0b\x0c"


def host(url: Column) -> Column:
    """The host of a URL in lower case; null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(url, HOST, 1), F.lit("")))


def page_text(html: Column) -> Column:
    """The text of an HTML page, a line for each block."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCKS, "\n"), TAGS, "")
    for name, character in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _hash(line: Column) -> Column:
    return F.xxhash64(_trimmed(line))


def drop_boilerplate(pages: DataFrame, site: str, text: str = "text", ratio: float = 0.1, least: int = LEAST, distinct: bool = False) -> DataFrame:
    """pages with its text rewritten, and n_lines and n_dropped added (of lines that aren't blank).

    A line (without white space at its ends) is dropped where at least `least` of the site's pages have it and they are more than ratio of
    the site's pages. Repeats within a page count once; blank lines are never counted, dropped or moved. A null site's
    pages are left alone; a null text stays null, with no lines. Lines are told apart by 64-bit hashes. Columns named
    n_lines, n_dropped are replaced. No pages give no rows. If distinct, pages of a site with the same text count as one page, in both
    numbers: copies of a page make no line of it boilerplate.
    """
    lines = F.split(F.col(text), "\n", -1)
    each = pages.select(F.col(site).alias("_site"), F.xxhash64(text).alias("_page"), F.array_distinct(F.transform(F.filter(lines, lambda x: _trimmed(x) != ""), _hash)).alias("_lines"))
    if distinct:
        each = written(each.filter(F.col("_site").isNotNull()).dropDuplicates(["_site", "_page"]))
    seen = each.select("_site", F.explode("_lines").alias("line"))
    common = seen.groupBy("_site", "line").count().filter((F.col("count") >= least) & F.col("_site").isNotNull())
    totals = each.groupBy("_site").agg(F.count(F.lit(1)).alias("total"))
    found = common.join(totals, "_site").filter(F.col("count") > F.col("total") * ratio).groupBy("_site").agg(F.collect_set("line").alias("_drop"), F.ceil(F.max("total") / PAGES).cast("int").alias("_parts"))
    found = written(found)
    size = found.agg(F.coalesce(F.sum(F.size("_drop")), F.lit(0))).first()[0]
    if size <= BROADCAST_LINES:
        x = pages.join(F.broadcast(found), pages[site].eqNullSafe(found["_site"]), "left")
    else:  # a large site's pages are dealt to parts, each of which gets the site's lines
        large, rows = counted(found.filter("_parts > 1").select("_site", "_parts"))
        parts = F.when(F.col("_site").isNull(), F.lit(1024)).otherwise(F.coalesce("_parts", F.lit(1)))
        x = keyed_join(pages.withColumn("_site", F.col(site)), large, ["_site"], "left", rows).withColumn("_part", F.pmod(F.xxhash64(*pages.columns), parts).cast("int")).drop("_parts")
        x = x.join(found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))), ["_site", "_part"], "left")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("_drop", _hash(x)), F.lit(False)) | (_trimmed(x) == ""))
    full = lambda of: F.coalesce(F.size(F.filter(of, lambda x: _trimmed(x) != "")), F.lit(0))
    n, left = F.when(F.col(text).isNull(), 0).otherwise(full(lines)), F.when(F.col(text).isNull(), 0).otherwise(full(F.split(F.col("_new"), "\n", -1)))
    x = x.withColumn("_new", F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return x.withColumns({"n_lines": n, "n_dropped": n - left}).withColumn(text, F.col("_new")).drop("_site", "_drop", "_new", "_part", "_parts")


def dedup_pages(pages: DataFrame, ratio: float = 0.1, least: int = LEAST) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of raw pages (page_id, url, html): their text without their host's boilerplate lines."""
    read = written(pages.select("page_id", host(F.col("url")).alias("host"), page_text(F.col("html")).alias("text")))
    return drop_boilerplate(read, "host", "text", ratio, least).select("page_id", "host", "n_lines", "n_dropped", "text")
