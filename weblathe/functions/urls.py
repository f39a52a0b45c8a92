"""Column builders for hosts and addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import canonical_host, is_public_address
from .vocabulary import SUFFIXES


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def last_labels(host: Column, n: int) -> Column:
    """The last n labels; empty if the host has fewer."""
    return F.array_join(F.slice(F.split(host, r"\."), -n, n), ".")


def suffix_labels(n: Column, depth: int, has: Callable[[int, str], Column], unlisted: bool) -> Column:
    """The labels of the public suffix of a host of n labels: an exception's less one, else the longest rule's.

    ``has(d, kind)`` tells whether the host's last d labels are a plain, wildcard or exception rule.
    """
    labels = F.when(F.lit(False), 0)
    for d in range(depth, 1, -1):
        labels = labels.when(has(d, "exception"), d - 1)
    for d in range(depth + 1, 0, -1):
        labels = labels.when((has(d, "plain") | has(d - 1, "wildcard")) & (n >= d), d)
    return labels.otherwise(int(unlisted))


def registrable_of(host: Column, labels: Column) -> Column:
    """The host's suffix of so many labels and one before it; null where that isn't there, or for an IPv4 address."""
    parts = F.split(host, r"\.")
    fits = (labels > 0) & (F.size(parts) > labels) & ~F.element_at(parts, -1).rlike("^[0-9]+$")
    return F.when(fits, F.array_join(F.slice(parts, F.size(parts) - labels, labels + 1), "."))


def registrable_domain(host: Column, rules: tuple[str, ...] = SUFFIXES, unlisted: bool = True) -> Column:
    """The public suffix and one label before it; null for a suffix, an IPv4 address, and a single label.

    ``rules`` is a short list of suffix rules (plain, ``*.``, ``!``) of any depth, kept in the expression; ``operators.suffixes``
    takes a table of them. ``unlisted``: a last label that no rule names is a suffix.
    """
    kinds = {"*.": "wildcard", "!": "exception"}
    names: dict[tuple[int, str], list[str]] = {}
    for rule in rules:
        mark = next((m for m in kinds if rule.startswith(m)), "")
        name = rule[len(mark) :]
        names.setdefault((name.count(".") + 1, kinds.get(mark, "plain")), []).append(name)
    depth = max((d for d, _ in names), default=0)
    has = lambda d, kind: last_labels(host, d).isin(*names[d, kind]) if (d, kind) in names else F.lit(False)
    return registrable_of(host, suffix_labels(F.size(F.split(host, r"\.")), depth, has, unlisted))


def politeness_key(host: Column) -> Column:
    return F.coalesce(registrable_domain(host), host)


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(registrable_domain(a), a) == F.coalesce(registrable_domain(b), b)


def normalized_target(target: Column) -> Column:
    """scheme://host[:port] of a target; https by default; null with credentials, another scheme or no valid host."""
    full = F.when(target.contains("://"), F.trim(target)).otherwise(F.concat(F.lit("https://"), F.trim(target)))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(full, r"^[^/]*//([^/?#]*)", 1)
    host, port = canonical_host(F.regexp_extract(authority, r"^([^:]*)", 1)), F.regexp_extract(authority, r":([0-9]+)$", 1)
    fine = scheme.isin("http", "https") & ~authority.contains("@") & host.isNotNull() & authority.rlike(r"^[^:]*(:[0-9]{1,5})?$")
    return F.when(fine, F.concat(scheme, F.lit("://"), host, F.when(port == "", "").otherwise(F.concat(F.lit(":"), port))))


def is_public_url(url: Column, addresses: Column) -> Column:
    """http(s), no credentials, default port, a full host name that isn't local, and only public addresses."""
    host, scheme = host_of(url), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    authority = F.regexp_extract(url, r"^[^/]*//([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    default = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    named = host.contains(".") & ~host.contains("%") & ~host.endswith("localhost")
    safe = F.size(addresses) > 0
    return F.coalesce(scheme.isin("http", "https") & ~authority.contains("@") & default & named & safe, F.lit(False)) & F.coalesce(F.array_min(addresses), F.lit(False))


def public_flags(addresses: Column) -> Column:
    """One flag for an address column, for use with ``is_public_url`` after grouping."""
    return F.coalesce(is_public_address(addresses), F.lit(False))
