"""Text functions as Columns: normalisation, slices, terms, links, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop-words of the full-text index. Fixed values.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but "
    "by can could did do does doing down during each few for from further had has have having he her here hers him "
    "his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out "
    "over own same she should so some such than that the their them then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with would you your"
).split()
#: Accents that are stripped before terms are cut. Fixed values.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normalize_markdown(text: Column) -> Column:
    """Line feeds as the only line ends, no white space at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?|[\x0B\f\x{85}\x{2028}\x{2029}]", "\n"), r"(?m)[\p{Z}\t]+$", "")


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Code points start..end, both from 1 and inclusive; what lies outside is left out."""
    return F.substring(text, start, F.greatest(end - start + 1, F.lit(0)))


def terms(text: Column, stop_words: bool = False, accents: bool = False) -> Column:
    """Array of lower-case runs of a-z, in order, repeats included."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if accents:
        low = F.translate(low, ACCENTED, PLAIN)
    found = F.array_remove(F.split(low, "[^a-z]+"), "")
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if stop_words else found


def embed_input(context: Column, text: Column) -> Column:
    """What is embedded for a chunk: its context, a line feed, its text."""
    return F.concat(F.coalesce(context, F.lit("")), F.lit("\n"), text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


#: Character references that occur in URLs, the ampersand last. Fixed values.
_REFERENCES = (("&(?:quot|#34|#x22);", '"'), ("&(?:apos|#39|#x27);", "'"), ("&(?:lt|#60|#x3c);", "<"), ("&(?:gt|#62|#x3e);", ">"), ("&(?:sol|#47|#x2f);", "/"), ("&(?:num|#35|#x23);", "#"), ("&(?:amp|#38|#x26);", "&"))


def links(html: Column) -> Column:
    """Sorted distinct href values of <a> tags, or of a sitemap its <loc> addresses, without fragments, one trailing slash
    and links to the page's own root. Comments, scripts and styles have no links; character references are decoded.

    A tag is walked attribute by attribute, by possessive runs, which need no stack: tags of any length are fine.
    """
    seen = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    other = r"""[\s/]++|"[^"]*+"|'[^']*+'|=|(?!href\s*+=)[^\s"'>=/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
    value = rf"""(?is)<a(?=[\s/])(?:{other})*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    hrefs = F.transform(F.regexp_extract_all(seen, F.lit(value), F.lit(1)), lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))
    places = F.regexp_extract_all(seen, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    found = F.when(seen.rlike(r"(?i)<(urlset|sitemapindex)[\s>]"), F.when(seen.rlike(r"(?i)<urlset[\s>]"), places).otherwise(F.array().cast("array<string>"))).otherwise(hrefs)

    def plain(h: Column) -> Column:
        decoded = h
        for pattern, character in _REFERENCES:
            decoded = F.regexp_replace(decoded, "(?i)" + pattern, character)
        return F.substring_index(F.trim(F.when(h.contains("&"), decoded).otherwise(h)), "#", 1)

    kept = F.filter(F.transform(found, plain), lambda h: ~h.isin("", "/", "./", "./index.html"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda h: F.regexp_replace(h, "/$", ""))))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without ``.`` and ``..`` segments."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    dots = F.element_at(parts, -1).isin(".", "..")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    whole = F.concat(F.lit("/"), F.array_join(F.when(dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def absolute_url(link: Column, page: Column) -> Column:
    """link resolved against the page's URL as RFC 3986 has it (without fragments)."""
    base = F.regexp_replace(page, "(?s)#.*$", "")
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)//", 1)
    path = F.regexp_extract(F.substring(base, F.length(root) + F.lit(1), F.lit(1 << 30)), r"^([^?]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("/"))
    rest, query = F.regexp_extract(link, r"^([^?]*)", 1), F.regexp_extract(link, r"(?s)^[^?]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, _without_dots(rest), query))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when(link == "", base)
        .otherwise(F.concat(root, _without_dots(F.concat(folder, rest)), query))
    )


def url_stem(url: Column) -> Column:
    """The prefix that child pages of a URL share: the folder of an .html page, the URL itself otherwise."""
    plain = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/?sitemap\\.xml$", "")
    return F.when(plain.endswith(".html"), F.regexp_replace(plain, "/[^/]*$", "")).otherwise(F.regexp_replace(plain, "/$", ""))


def linkify(text: Column) -> Column:
    """Bare http(s) URLs as anchors, but not those that end in an ellipsis."""
    return F.regexp_replace(text, r"""(?<!["'>])(https?://[^\s<>"']+)(?<!…)(?![^\s<>"'])""", r'<a href="$1">$1</a>')


def duration_seconds(text: Column) -> Column:
    """Seconds of durations such as 1h2m0.5s or 250ms; null for others."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")), F.lit("999999999.999999")).cast("double"), F.lit(0.0))
    total = part("h") * 3600 + part("m(?!s)") * 60 + part("(?<!m)s") + part("ms") / 1000
    return F.when(text.rlike(r"^(\d+(\.\d+)?(h|ms|m|s))+$"), total)
