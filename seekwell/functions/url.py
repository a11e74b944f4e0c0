"""URLs as column expressions: parts, normal form, owner worker, relative links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekwell.functions.text import java_hash

#: scheme, authority, path, query, fragment of an absolute http or https URL.
WHOLE = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, WHOLE, group)


def is_web_url(url: Column) -> Column:
    """Only http and https URLs with a host have parts; null has none."""
    return F.coalesce(url.rlike(WHOLE) & (F.substring_index(_part(url, 2), ":", 1) != ""), F.lit(False))


def host(url: Column) -> Column:
    return F.when(is_web_url(url), F.substring_index(_part(url, 2), ":", 1))


def port(url: Column) -> Column:
    """The port after the host; the scheme's own if there is none or it is no number."""
    said = F.regexp_extract(_part(url, 2), r":([0-9]{1,5})$", 1)
    own = F.when(_part(url, 1) == "https", 443).otherwise(80)
    return F.when(is_web_url(url), F.when(said == "", own).otherwise(F.nullif(said, F.lit("")).cast("int")))


def url_parts(url: Column) -> Column:
    """struct(secure, host, port, path, query, anchor, full); null for anything but http and https URLs."""
    path, query, anchor = _part(url, 3), _part(url, 4), _part(url, 5)
    full = F.concat(_part(url, 1), F.lit("://"), host(url), F.lit(":"), port(url).cast("string"), path, query, anchor)
    return F.when(
        is_web_url(url),
        F.struct(
            (_part(url, 1) == "https").alias("secure"), host(url).alias("host"), port(url).alias("port"), path.alias("path"),
            query.alias("query"), anchor.alias("anchor"), full.alias("full"),
        ),
    )


def normalize(url: Column) -> Column:
    """scheme://host:port/path?query without the fragment; null if it can't be parsed."""
    return F.when(
        is_web_url(url),
        F.concat(_part(url, 1), F.lit("://"), host(url), F.lit(":"), port(url).cast("string"), _part(url, 3), _part(url, 4)),
    )


def protocol_domain(url: Column) -> Column:
    """scheme://host:port, as robot rules are kept by it."""
    return F.when(is_web_url(url), F.concat(_part(url, 1), F.lit("://"), host(url), F.lit(":"), port(url).cast("string")))


def worker_of(url: Column, workers: int) -> Column:
    """Which of `workers` owns the URL's host."""
    return F.pmod(F.abs(java_hash(host(url))), F.lit(workers)).cast("int")


def with_scheme(url: Column) -> Column:
    """Seeds without a scheme are taken as https."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def host_is_suspect(url: Column) -> Column:
    """A data-quality flag: a host that still holds separators."""
    return F.coalesce(host(url).rlike("[#?:]"), F.lit(True))


def resolve(base: Column, link: Column) -> Column:
    """A link on a page: absolute ones stay, `//x` takes the scheme, `/x` the host, others the page's folder."""
    scheme, root = _part(base, 1), F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.rlike("^https?://"), link)
        .when(~is_web_url(base) | link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#"), F.concat(root, _part(base, 3), _part(base, 4), link))
        .when(link == "", F.concat(root, _part(base, 3), _part(base, 4)))
        .otherwise(F.concat(root, folder, link))
    )
