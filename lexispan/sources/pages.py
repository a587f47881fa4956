"""Pages: article text, metadata, and which addresses may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = r"(?is)<(?:h[1-4]|p|li|blockquote)\b[^>]*>([^<]*(?:<(?!/?(?:h[1-4]|p|li|blockquote|ul|ol|div|section|article|body)\b)[^>]*>[^<]*)*)"
#: Named entities (fixed values); the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def without_chrome(html: Column) -> Column:
    """The page without comments, scripts, styles, navigation, header and footer."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "header", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return out


def plain(html: Column) -> Column:
    out = F.regexp_replace(html, r"<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def article_text(html: Column) -> Column:
    """Text of headings, paragraphs, list items and quotes in order, by blank lines; else all of the page's text."""
    body = without_chrome(F.coalesce(html, F.lit("")))
    blocks = F.filter(F.transform(F.regexp_extract_all(body, F.lit(_BLOCK), F.lit(1)), plain), lambda b: b != "")
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(plain(body))


def title(html: Column) -> Column:
    return plain(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def host(url: Column) -> Column:
    """The host in small letters, an IPv6 address with its brackets, without dots at its end."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def admissible(url: Column) -> Column:
    """http or https, with a host that is no local name and no address beside the public ones.

    What looks like a number but is no plain dotted address (integers, hexadecimal, octal or short forms) is refused, and so
    is every IPv6 address outside the public range; names aren't resolved here."""
    name = host(url)
    parts = F.transform(F.split(name, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))
    a, b, c = (F.get(parts, F.lit(k)) for k in range(3))
    literal = name.rlike(r"^(25[0-5]|2[0-4][0-9]|1?[1-9]?[0-9]|1[0-9][0-9])(\.(25[0-5]|2[0-4][0-9]|1?[1-9]?[0-9]|1[0-9][0-9])){3}$")
    closed = (
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a >= 224)
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    numeric = name.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*$") & ~literal
    six = name.contains("[") | name.contains("]")
    public_six = name.rlike(r"^\[[23][0-9a-f]{3}:[0-9a-f:]+\]$") & ~name.rlike(r"^\[(2001:(0{0,3}[0-9a-f]?|0?[01][0-9a-f]{0,2}|0?db8)?:|2002:|3fff:)")
    local = name.rlike(r"(^|\.)localhost$") | name.rlike(r"\.(local|internal)$") | name.rlike(r"[\s%]")
    return F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://") & (name != "") & ~local & ~(literal & closed) & ~numeric & (~six | public_six)


def byline(html: Column) -> Column:
    """The author that a page's meta tags name, empty if none."""
    return plain(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<meta\b[^>]*\bname=[\"']author[\"'][^>]*\bcontent=[\"']([^\"']*)", 1))


def heading(html: Column) -> Column:
    """The first heading of level 1 to 3, empty if none."""
    return plain(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>", 1))


def imported(pages: DataFrame) -> DataFrame:
    """page_id, title, byline, url, text, source and words: the readable text if it has 200 characters, else a selection, else all text.

    selection and final_url are taken where pages has columns of these names."""
    best, whole = article_text(F.col("html")), plain(without_chrome(F.coalesce("html", F.lit(""))))
    chosen = F.col("selection") if "selection" in pages.columns else F.lit(None).cast("string")
    url = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    long, some = F.length(best) >= 200, F.trim(F.coalesce(chosen, F.lit(""))) != ""
    rows = pages.select("page_id", F.coalesce(F.nullif(title(F.col("html")), F.lit("")), heading(F.col("html"))).alias("title"), byline(F.col("html")).alias("byline"), url.alias("url"),
                        F.when(long, best).when(some, chosen).otherwise(whole).alias("text"), F.when(long, "readable").when(some, "selection").otherwise("body").alias("source"))
    return rows.withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long"))


def articles(pages: DataFrame) -> DataFrame:
    """page_id, title, host, text and words."""
    text = article_text(F.col("html"))
    rows = pages.select("page_id", title(F.col("html")).alias("title"), host(F.col("url")).alias("host"), text.alias("text"))
    return rows.withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long"))
