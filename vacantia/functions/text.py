"""Titles, companies, locations, links, identifiers and display labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import BLANK, contains_any, filled, not_blank, once, squeeze, strip, text

# RFC 3986 split: scheme, authority, path, query, fragment.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _url_part(url: Column, part: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _URL, part)


def url_host(url: Column) -> Column:
    """Lower-cased host without user info and port; empty when there is none."""
    authority = F.regexp_replace(_url_part(url, 2), r"^.*@|:\d*$", "")
    return F.lower(authority)


def url_path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(_url_part(url, 3), r";[^/]*$", "")


def normalize_title(title: Column) -> Column:
    return squeeze(title)


def normalize_company(name: Column) -> Column:
    return squeeze(name)


def canonical_location(location: Column) -> Column:
    tidy = squeeze(filled(location))
    tidy = F.replace(tidy, F.lit("United States of America"), F.lit("United States"))
    return F.replace(tidy, F.lit("US-Remote"), F.lit("Remote - US"))


def curated_location(location: Column) -> Column:
    tidy = F.regexp_replace(strip(text(location)), rf"(?U){BLANK}+", " ")
    tidy = F.regexp_replace(tidy, r"(?iU)(,\s*)?remote(\s*,\s*remote)+", " remote")
    return F.regexp_replace(tidy, r"(?iU)\bremote\s+in\s+usa\b", "Remote (US)")


def curated_company(name: Column) -> Column:
    bare = F.regexp_replace(strip(text(name)), r"(?U)^[^\w(\[]+", "")
    return strip(F.regexp_replace(bare, rf"(?U){BLANK}+", " "))


def slugify(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(value)), r"[^a-z0-9]+", "-"), F.lit("-"))


def company_token(company: Column, url: Column) -> Column:
    """Slug of the company, else of the link's host, else ``unknown``."""
    return F.coalesce(filled(slugify(company)), filled(slugify(url_host(url))), F.lit("unknown"))


def _kept_query(url: Column) -> Column:
    """The one query parameter that identifies a posting, last value first, re-encoded."""
    values = F.regexp_extract_all(_url_part(url, 4), F.lit(r"(?:^|&)gh_jid(?:=([^&]*))?(?=&|$)"), 1)
    last = F.try_element_at(values, F.lit(-1))
    encoded = F.url_encode(F.coalesce(F.try_url_decode(last), last))
    encoded = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(F.size(values) > 0, F.concat(F.lit("?gh_jid="), encoded)).otherwise("")


def canonical_url(url: Column) -> Column:
    """Drop trackers, force https; null for aggregator pages that are no posting."""
    def rebuild(u):
        query, scheme, authority, fragment = _kept_query(u), F.lower(_url_part(u, 1)), _url_part(u, 2), _url_part(u, 5)
        section = F.regexp_extract(_url_part(u, 3), r"^/*([^/]*)", 1)
        no_posting = (url_host(u) == V.AGGREGATOR_HOST) & ~section.isin("p", "c") & (query == "")
        rebuilt = F.concat(
            F.when(scheme == "", "").when(scheme == "http", "https:").otherwise(F.concat(scheme, F.lit(":"))),
            F.when(authority == "", "").otherwise(F.concat(F.lit("//"), authority)),
            _url_part(u, 3),
            query,
            F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment)),
        )
        return F.when(u.isNotNull() & ~no_posting, rebuilt)
    return once(url, rebuild)


def hashed_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def legacy_id(company_href: Column, row_url: Column) -> Column:
    """Id of the company link, when it leads elsewhere than the posting."""
    legacy = canonical_url(filled(company_href))
    return F.when((legacy != "") & (legacy != row_url), hashed_id(legacy))


def external_id(row_columns, url: Column) -> Column:
    """First non-blank id column, else the last path segment, else the url."""
    keys = [F.when(not_blank(F.col(k).cast("string")), F.col(k).cast("string"))
            for k in V.EXTERNAL_ID_KEYS if k in row_columns]
    whole = filled(strip(text(url)))
    segment = F.regexp_extract(F.rtrim(url_path(whole), F.lit("/")), r"([^/]*)$", 1)
    return F.coalesce(*keys, filled(segment), whole)


def _link_part(cell: Column, group: int, plain) -> Column:
    """Label or address of the link labelled "apply", else of the first one; ``plain`` without links."""
    def pick(bare):
        pairs = F.arrays_zip(
            F.regexp_extract_all(bare, F.lit(V.MARKDOWN_LINK), 1).alias("label"),
            F.regexp_extract_all(bare, F.lit(V.MARKDOWN_LINK), group).alias("part"))
        apply_first = F.filter(pairs, lambda p: F.lower(p["label"]).contains("apply"))
        picked = F.coalesce(F.try_element_at(apply_first, F.lit(1)), F.try_element_at(pairs, F.lit(1)))
        return F.coalesce(strip(picked["part"]), plain(bare))
    return once(strip(text(cell)), pick)


def link_url(cell: Column) -> Column:
    """Link of a Markdown cell: one labelled "apply", else the first, else the bare url."""
    return _link_part(cell, 2, lambda bare: F.when(bare.rlike("^https?://"), bare))


def link_text(cell: Column) -> Column:
    """Display text belonging to ``link_url``."""
    return _link_part(cell, 1, lambda bare: bare)


def unlinked(cell: Column) -> Column:
    """Replace Markdown links by their labels."""
    return strip(F.regexp_replace(text(cell), V.MARKDOWN_LINK, "$1"))


def with_default(value: Column, default) -> Column:
    return F.coalesce(filled(value), default if isinstance(default, Column) else F.lit(default))


def skill_label(label: Column) -> Column:
    """Trimmed skill label; null when blank.  For (label, weight) pairs pass the label field."""
    return filled(strip(label))


def display_date(posted_at: Column) -> Column:
    return F.coalesce(F.date_format(posted_at, "MMM d, yyyy"), F.lit("—"))


def display_level(level: Column) -> Column:
    known = F.lower(F.coalesce(level, F.lit("unknown")))
    return F.when(known == "senior", "Senior").when(known == "mid", "Mid").otherwise("Junior")


def shows_slug(slug: Column, name: Column) -> Column:
    """Whether the slug says more than the display name."""
    def bare(c):
        return F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]", "")
    return (bare(slug) != "") & (bare(slug) != bare(name))


def haystack(title: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", text(title), text(description)))


def matched_terms(hay: Column, terms) -> Column:
    """Sorted array of the terms found in a lower-cased text."""
    candidates = sorted(set(terms))
    if not candidates:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(hay.contains(t), F.lit(t)) for t in candidates]))


def slug_candidates(token: Column, html: Column) -> Column:
    """Ordered distinct board slugs: token variants, then those a page names."""
    page = text(html)
    dotted = token.contains(".")
    variants = F.when(
        dotted,
        F.array(token, F.replace(token, F.lit("."), F.lit("-")), F.replace(token, F.lit("."), F.lit("")),
                F.substring_index(token, ".", 1)),
    ).otherwise(F.array(token))
    named = F.regexp_extract_all(page, F.lit(r'(?i)"organizationSlug"\s*:\s*"([a-z0-9\-\.]+)"'), 1)
    blocks = F.regexp_extract_all(page, F.lit(r'(?s)"organization"\s*:\s*\{.*?\}'), 0)
    in_blocks = F.flatten(F.transform(
        blocks, lambda b: F.regexp_extract_all(b, F.lit(r'(?iU)\bslug"\s*:\s*"([a-z0-9\-\.]+)"'), 1)))
    attributes = F.regexp_extract_all(page, F.lit(r'data-organization-slug="([^"]+)"'), 1)
    return F.array_distinct(F.concat(variants, named, in_blocks, attributes))


def raw_list_urls(address: Column) -> Column:
    """Ordered distinct addresses at which the raw text of a curated list may lie."""
    bare = F.rtrim(address, F.lit("/"))
    raw_host = F.lit("https://raw.githubusercontent.com/")
    rel = F.replace(bare, F.lit("https://github.com/"), F.lit(""))
    repo = F.regexp_extract(rel, r"^(.*?)/blob/", 1)
    tail = F.regexp_extract(rel, r"^.*?/blob/(.*)$", 1)
    branch = F.substring_index(tail, "/", 1)
    path = F.when(tail.contains("/"), F.regexp_extract(tail, r"^[^/]*/(.*)$", 1)).otherwise("README.md")

    def at(owner, where, file):
        return F.concat(raw_host, owner, F.lit("/"), where, F.lit("/"), file)

    blob = F.array(*[at(repo, b, path) for b in (branch, *map(F.lit, V.LIST_BRANCHES))])
    root = F.array(*[at(rel, F.lit(b), F.lit(f)) for b in V.LIST_BRANCHES for f in V.LIST_FILES])
    urls = (
        F.when(~bare.startswith("https://github.com/"), F.array(bare))
        .when(rel.contains("/blob/"), blob)
        .otherwise(root)
    )
    return F.array_distinct(urls)


def list_column(header: Column, kind: str) -> Column:
    """Zero-based position of the first header cell naming the column kind; null when absent."""
    hits = F.transform(header, lambda cell: contains_any(F.lower(cell), V.LIST_COLUMNS[kind]))
    position = F.nullif(F.array_position(hits, F.lit(True)), F.lit(0).cast("long"))
    return (position - 1).cast("int")


