"""Which chat site a URL belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Site registry (host, site), first match wins, and popup hosts.
# ---------------------------------------------------------------------------
SITES = (
    ("chatgpt.com", "chatgpt"),
    ("chat.openai.com", "chatgpt"),
    ("claude.ai", "claude"),
    ("gemini.google.com", "gemini"),
    ("copilot.microsoft.com", "copilot"),
    ("perplexity.ai", "perplexity"),
    ("poe.com", "poe"),
    ("character.ai", "character"),
    ("mistral.ai", "mistral"),
    ("huggingface.co", "huggingface"),
    ("you.com", "you"),
)
POPUP_HOSTS = (
    "chatgpt.com",
    "claude.ai",
    "gemini.google.com",
    "copilot.microsoft.com",
    "perplexity.ai",
    "poe.com",
)
GENERIC = "generic"
# End of fixed values.


def url_host(url: Column) -> Column:
    """The lower-case host of a URL, NULL where it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def site_of(host: Column) -> Column:
    """The site of a host or of any host below it, else ``generic``."""
    site = F.lit(GENERIC)
    for known, name in reversed(SITES):
        site = F.when(
            (host == known) | host.endswith("." + known), F.lit(name)
        ).otherwise(site)
    return site


def popup_site(host: Column) -> Column:
    """The first popup host that is part of the host, else NULL."""
    site = F.lit(None).cast("string")
    for known in reversed(POPUP_HOSTS):
        site = F.when(host.contains(known), F.lit(known)).otherwise(site)
    return site


def covered(host: Column) -> Column:
    """Whether detection is active on the host: registry hosts, exact only."""
    return F.coalesce(host.isin(*(known for known, _ in SITES)), F.lit(False))


def attribute_sites(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``, ``site``, ``popup_site`` and ``covered``: no join, no shuffle."""
    return (
        df.withColumn("host", url_host(F.col(url)))
        .withColumn("site", site_of(F.col("host")))
        .withColumn("popup_site", popup_site(F.col("host")))
        .withColumn("covered", covered(F.col("host")))
    )
