"""Pages as records: title, text, links, and the children of hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.functions.ids import CHILD_KEYWORDS, DEDICATED_HOSTS, SOCIAL_HOSTS, host_in, host_of, norm_url, normalize_web_url, path_of, web_url_hash
from lodestar.session import small

#: Character references of plain markup.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """The most common character references as characters; the ampersand last."""
    for name, character in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def title(html: Column, url: Column) -> Column:
    """Title for sharing, else the title, else the end of the address."""
    shared = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)""", 1)
    own = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    slug = F.element_at(F.split(path_of(url), "/"), -1)
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(decoded(c), r"\s+", " ")), F.lit(""))
    return F.coalesce(clean(shared), clean(own), slug)


def plain_text(html: Column) -> Column:
    """Text of a page without scripts, styles, menus, headers and footers; three line feeds or more are two."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|nav|header|footer)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|br)\b[^>]*>", "\n")
    text = decoded(F.regexp_replace(text, r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as raw records."""
    return pages.select("page_id", "url", web_url_hash(F.col("url")).alias("url_hash"), title(F.col("html"), F.col("url")).alias("title"), plain_text(F.col("html")).alias("text"))


def call_fields(text: Column) -> dict[str, Column]:
    """Mode, areas, deadline (yyyy-mm-dd) and status that a call's text gives away."""
    deadline = F.regexp_extract(text, r"(?iu)(?:prazo|data.limite|inscri\S+ at[ée])\D{0,40}(\d{2}/\d{2}/\d{4})", 1)
    day = F.try_to_date(F.nullif(deadline, F.lit("")), "dd/MM/yyyy")
    flows = text.rlike("(?iu)fluxo cont[íi]nuo")
    return {
        "mode": F.nullif(F.regexp_extract(text, r"(?iu)modalidades?:\s*([^\n.]+)", 1), F.lit("")),
        "areas": F.nullif(F.regexp_extract(text, r"(?iu)[áa]reas?:\s*([^\n.]+)", 1), F.lit("")),
        "deadline": F.date_format(day, "yyyy-MM-dd"),
        "continuous": flows,
        "status": F.when(flows, "FLUXO_CONTINUO").when(day.isNotNull(), "ABERTA").otherwise("Desconhecido"),
    }


def links(pages: DataFrame) -> DataFrame:
    """Links (page_id, url, place, href, absolute): addresses that start with a slash get the page's scheme and host."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""), F.lit(1))).alias("place", "href"))
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return found.withColumn("absolute", F.when(F.col("href").rlike(r"^(?i)https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, F.col("href"))))


def hub_children(found: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Links of hubs that may be calls: of the hub's host, below its path or with a word for calls, each once, not known yet.

    The most first ones of a page stay. found: links(); known: (norm).
    """
    path, hub_path = path_of(F.col("absolute")), path_of(F.col("url"))
    words = F.lower(path).rlike("|".join(CHILD_KEYWORDS))
    below = (hub_path != "") & path.startswith(F.concat(hub_path, F.lit("/")))
    some = found.where(F.col("absolute").isNotNull()).where(host_of(F.col("absolute")) == host_of(F.col("url"))).where((path != "") & (path != hub_path)).where(below | words)
    some = some.where(~host_in(F.col("absolute"), SOCIAL_HOSTS) & ~host_in(F.col("absolute"), DEDICATED_HOSTS)).withColumn("norm", norm_url(F.col("absolute")))
    fresh = some.join(known.select("norm"), "norm", "left_anti")
    once = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "norm").orderBy("place"))).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("place"))).where(F.col("_n") <= most).select("page_id", "norm", "place")


def fresh_only(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates (url) whose address no ledger (norm) has."""
    return candidates.withColumn("norm", norm_url(F.col("url"))).join(ledger.select("norm"), "norm", "left_anti")


def not_rejected(candidates: DataFrame, rejected: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Candidates (norm) that weren't rejected within some days; moments that can't be read have run out."""
    recent = rejected.where(F.try_to_timestamp("rejected_at") > now - F.expr(f"INTERVAL {days} DAYS"))
    return candidates.join(recent.select("norm"), "norm", "left_anti")


def stage(staged: DataFrame, records: DataFrame) -> DataFrame:
    """Records to add: addresses that aren't staged yet, each once (the first by seq)."""
    once = records.withColumn("_n", F.row_number().over(Window.partitionBy("url_hash").orderBy("seq"))).where("_n = 1").drop("_n")
    return once.join(staged.select("url_hash"), "url_hash", "left_anti")


def within_budget(candidates: DataFrame, budgets: DataFrame) -> DataFrame:
    """The first candidates of each channel (channel, seq), as many as its budget (channel, budget)."""
    place = F.row_number().over(Window.partitionBy("channel").orderBy("seq"))
    return candidates.withColumn("_n", place).join(small(budgets), "channel").where("_n <= budget").drop("_n", "budget")


def identity(url: Column) -> dict[str, Column]:
    """All that a URL is known by."""
    return {"norm": norm_url(url), "normal": normalize_web_url(url), "url_hash": web_url_hash(url), "host": host_of(url), "social": host_in(url, SOCIAL_HOSTS), "dedicated": host_in(url, DEDICATED_HOSTS)}
