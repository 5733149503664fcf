"""Page identity: what makes two URLs one page or one site. Pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.text import clean_text

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _PARTS, 1))


def netloc(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 2)


def path(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 3)


def query(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 4)


def host(net: Column) -> Column:
    """A network location without credentials, port, `www.` or case."""
    bare = F.substring_index(F.substring_index(net, "@", -1), ":", 1)
    return F.regexp_replace(F.lower(bare), r"^www\.", "")


def site_key(c: Column) -> Column:
    """One site: `https://www.x.cat/a` and `x.cat` agree."""
    return host(F.when(F.contains(c, F.lit("//")), netloc(c)).otherwise(c))


def url_key(c: Column) -> Column:
    """One page: site, path without a trailing slash, query. Scheme and fragment do not count."""
    return F.concat(
        host(netloc(c)), F.regexp_replace(path(c), "/+$", ""), F.lit("?"), query(c)
    )


def classify(c: Column) -> Column:
    """struct(website_url, instagram_url, crawl_enabled) of an organisation's URL."""
    url = clean_text(c)
    usable = scheme(url).isin("http", "https") & (netloc(url) != "")
    name = host(netloc(url))
    social = F.lit(False)
    for known in vocab.INSTAGRAM_HOSTS:
        social = social | (name == known) | name.endswith("." + known)
    return F.struct(
        F.when(usable & ~social, url).alias("website_url"),
        F.when(usable & social, url).alias("instagram_url"),
        F.coalesce(usable & ~social, F.lit(False)).alias("crawl_enabled"),
    )
