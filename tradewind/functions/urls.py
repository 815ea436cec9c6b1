"""Relative links as absolute ones, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _without_dots(path: Column) -> Column:
    """A path with its dot segments taken out: "." stays where it is, ".." goes one up, never above the root."""
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
    kept = F.aggregate(
        F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done).when(part == "..", up(done)).otherwise(F.concat(done, F.array(part))),
    )
    ends = path.rlike(r"/\.{1,2}$")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise(""))


def resolved(base: Column, link: Column) -> Column:
    """The address that ``link`` means on the page ``base``: absolute, protocol-relative, rooted, relative, query or fragment only."""
    part = lambda pattern: F.regexp_extract(base, r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*:)//([^/?#]*))?([^?#]*)(\?[^#]*)?", pattern)
    scheme, host, path, query = part(1), part(2), F.when(part(3) == "", "/").otherwise(part(3)), part(4)
    site = F.concat(scheme, F.lit("//"), host)
    target = F.trim(link)
    own = F.regexp_extract(target, r"^([^?#]*)", 1)
    tail = F.substring(target, F.length(own) + 1, F.length(target))
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target == "", F.concat(site, path, query))
        .when(target.startswith("#"), F.concat(site, path, query, target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("/"), F.concat(site, _without_dots(own), tail))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), tail))
    )
