"""Column builders for text: all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)[\s\x1c-\x1f]+"  # Unicode white space


def lit_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def squeeze(text: Column, limit: int = 4096) -> Column:
    """White space as single blanks, trimmed, cut to ``limit``; null if nothing is left."""
    return F.nullif(F.left(F.trim(F.regexp_replace(text, WHITE, " ")), F.lit(limit)), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def hyphened(text: Column) -> Column:
    """Letters and digits joined by hyphens."""
    return F.array_join(words_of(text), "-")


def has_marker(text: Column, marker: str) -> Column:
    """A one-word marker is a whole word of the text; a longer one is part of its hyphened form."""
    return F.array_contains(words_of(text), marker) if marker.isalnum() else hyphened(text).contains(marker)


def any_of(conditions) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def has_bounded_marker(hyphens: Column, marker: str) -> Column:
    """The marker stands between hyphens or ends in a hyphened form."""
    return F.concat(F.lit("-"), hyphens, F.lit("-")).contains(f"-{marker}-")


def ladder(steps, otherwise) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in steps:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def policy_score(text: Column) -> Column:
    """How likely a link leads to terms of use."""
    form, words = hyphened(text), words_of(text)
    has = lambda w: F.array_contains(words, w)
    return ladder(
        [
            (form.contains("scraping-policy") | form.contains("ai-policy"), 120),
            (any_of(form.contains(m) for m in ("acceptable-use", "terms-of-service", "terms-of-use")), 110),
            (has("aup"), 105),
            (has("terms"), 90),
            (has("legal"), 70),
        ],
        0,
    )


def economic_score(text: Column) -> Column:
    """How likely a link leads to prices or conditions of an API."""
    form, words = hyphened(text), words_of(text)
    overlap = lambda *w: F.arrays_overlap(words, lit_array(w))
    return ladder(
        [
            (form.contains("api-pricing"), 120),
            (overlap("pricing", "prices", "plans") & F.array_contains(words, "api"), 105),
            (overlap("pricing", "prices", "plans"), 100),
            (form.contains("registration-requirements"), 90),
            (form.contains("api-docs") | form.contains("developer-docs"), 70),
            (overlap("developers", "developer"), 50),
        ],
        0,
    )


def cut_with_dots(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def display_cell(status: Column, value_json: Column) -> Column:
    """A report cell: the value if collected, else the status in words; a dash if there is none."""
    return F.when(status.isNull(), F.lit("—")).when(status == "collected", cut_with_dots(value_json, 40)).otherwise(F.regexp_replace(status, "_", " "))


def error_cell(messages: Column) -> Column:
    return cut_with_dots(F.array_join(F.transform(messages, lambda m: F.replace(m, F.lit("|"), F.lit("\\|"))), "; "), 80)


def family(signal: Column) -> Column:
    return F.substring_index(signal, ".", 1)


def suffix_match(name: Column, suffix: Column) -> Column:
    """The name is the suffix or below it; a suffix that ends in "-" matches anywhere."""
    clean = F.rtrim(F.lower(name), F.lit("."))
    return F.when(suffix.endswith("-"), clean.contains(suffix)).otherwise((clean == suffix) | clean.endswith(F.concat(F.lit("."), suffix)))


def providers(names: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Sorted providers with a suffix that matches any of the names."""
    every = F.coalesce(names, F.array().cast("array<string>"))
    under = lambda suffixes: F.exists(every, lambda name: any_of(suffix_match(name, F.lit(s)) for s in suffixes))
    hits = [F.when(under(suffixes), F.lit(provider)) for provider, suffixes in sorted(table.items())]
    return F.array_compact(F.array(*hits))


def dns_name(value: Column) -> Column:
    return F.nullif(F.left(F.lower(F.rtrim(F.trim(value), F.lit("."))), F.lit(253)), F.lit(""))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait from a Retry-After header: a whole number or an HTTP date; null if neither."""
    text = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    seconds = F.when(text.rlike(r"^\+?[0-9]+$"), F.regexp_replace(text, r"\+", "").cast("double"))
    return F.coalesce(seconds, F.when(date.isNotNull(), F.greatest(F.lit(0.0), date.cast("double") - now.cast("double"))))


def is_text_type(content_type: Column) -> Column:
    """HTML, XHTML or plain text."""
    return F.lower(content_type).rlike("^(text/html|application/xhtml\\+xml|text/plain)")


def distinguished_name(parts: Column) -> Column:
    """An array of (key, value) as "key=value, key=value"."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws("=", p["key"], p["value"])), ", ")
