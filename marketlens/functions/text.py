"""Text normalisation as Column expressions: keys for joins, display forms, and values read out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import folds, without_accents

# Accented Latin letters and what they become in a key.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Dial prefixes by country.
DIAL = {"+33": "FR", "+49": "DE", "+41": "CH", "+34": "ES", "+39": "IT", "+32": "BE", "+31": "NL", "+43": "AT", "+48": "PL", "+46": "SE", "+352": "LU"}


def strip_accents(text: Column) -> Column:
    """Lower-cased text without accents."""
    return without_accents(F.lower(text))


def market_form(text: Column) -> Column:
    """Without accents, trimmed, runs of blanks and dashes single, quotes straight; letters keep their case."""
    quotes = F.translate(without_accents(text), "’‘", "''")
    return F.regexp_replace(F.trim(F.regexp_replace(quotes, r"(?U)\s+", " ")), r"--+", "-")


def market_text(text: Column) -> Column:
    """The form by which names are compared: market_form in lower case."""
    return F.lower(market_form(text))


def lookup_text(text: Column) -> Column:
    """Separators as single spaces, sharp s spelt out."""
    spelt = F.replace(strip_accents(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(spelt, r"[ \t\r\n\-_/.,+'()]+", " "))


def compact_key(text: Column) -> Column:
    """Letters a-z and digits alone: the join key of names."""
    return F.regexp_replace(lookup_text(text), "[^a-z0-9]+", "")


def joined_int(text: Column) -> Column:
    """All digits of a text as one number: "75 000 km" is 75000; null if there is none or it is too large."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("int")


def first_int(text: Column) -> Column:
    """The first group of digits alone."""
    return F.regexp_extract(text, "[0-9]+", 0).try_cast("int")


def loose_int(text: Column) -> Column:
    """ "82.0" is 82; blanks and other text are null."""
    return F.trim(text).try_cast("double").cast("int")


def without_roman_suffix(text: Column) -> Column:
    """Drop a last token of roman digits from names of two or more tokens."""
    return F.regexp_replace(text, r" +[ivxIVX]{1,5}$", "")


def slug(text: Column) -> Column:
    """Trimmed and lower-cased, white space as hyphens; everything but a-z, 0-9 and hyphens goes, accented letters too."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", "-"), "[^a-z0-9-]", "")


def title(text: Column) -> Column:
    """A capital after every character that is no letter ("c-hr" is "C-Hr")."""
    marked = F.regexp_replace(F.lower(text), r"([^\p{L}]|^)(\p{L})", "$1\u0001$2")
    parts = F.split(marked, "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))), "")


def caption_text(text: Column) -> Column:
    """Distinct lines in order, tags dropped, joined by spaces; headers, time lines, counters and blank lines go."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^WEBVTT|-->|^[0-9]+$|^(Kind|Language):"))
    return F.array_join(F.array_distinct(kept), " ")


def phone_digits(phone: Column) -> Column:
    """A phone number without blanks, dots, dashes and "(0)"; a leading 00 becomes +."""
    bare = F.regexp_replace(F.regexp_replace(F.replace(phone, F.lit("(0)"), F.lit("")), r"[ \t.\-()]", ""), "^00", "+")
    return bare


def dial_country(phone: Column) -> Column:
    """Country of the longest dial prefix that matches; null for others."""
    return country_of_number(phone_digits(phone))


def country_of_number(number: Column) -> Column:
    """The same of a number's digits: a look into the prefixes for each of their lengths."""
    found = F.create_map(*[F.lit(x) for item in DIAL.items() for x in item])
    return F.coalesce(*[F.try_element_at(found, F.substring(number, 1, n)) for n in sorted({len(x) for x in DIAL}, reverse=True)])


def alike(a: Column, b: Column) -> Column:
    """Brands match if equal, or either contains the other; a null matches all."""
    x, y = compact_key(a), compact_key(b)
    return F.coalesce(F.contains(x, y) | F.contains(y, x), F.lit(True))


def category_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/ad/([a-z_]+)/", 1), F.lit(""))


def country_of(url: Column) -> Column:
    """Country of the first listed domain ending in a URL; FR if there is none."""
    out = F.lit("FR")
    for ending, country in reversed([(".fr", "FR"), (".de", "DE"), (".ch", "CH"), (".it", "IT"), (".es", "ES"), (".be", "BE")]):
        out = F.when(F.contains(url, F.lit(ending)), F.lit(country)).otherwise(out)
    return out


# Regions as they were named before 2016, and their names since.
NEW_REGIONS = {
    "Nouvelle-Aquitaine": ["aquitaine", "limousin", "poitou-charentes"],
    "Grand Est": ["alsace", "lorraine", "champagne-ardenne"],
    "Hauts-de-France": ["nord-pas-de-calais", "picardie"],
    "Occitanie": ["languedoc-roussillon", "midi-pyrenees", "midi-pyrénées"],
    "Bourgogne-Franche-Comte": ["bourgogne", "franche-comte", "franche-comté"],
    "Normandie": ["haute-normandie", "basse-normandie"],
    "Auvergne-Rhone-Alpes": ["auvergne", "rhone-alpes", "rhône-alpes"],
    "Provence-Alpes-Cote d'Azur": ["provence-alpes-cote d'azur", "paca"],
}


def current_region(region: Column) -> Column:
    """The region's present name; empty is null, names that are not old stay as they are."""
    out = F.when(region.isNull() | (region == ""), F.lit(None).cast("string"))
    for name, old in NEW_REGIONS.items():
        out = out.when(F.lower(F.trim(region)).isin(old), name)
    return out.otherwise(region)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def keywords_in(text: Column, keywords: list[str], local: list[str] = ()) -> Column:
    """The keywords that a lower-cased text holds, in their order; short ones (3 letters) as whole words only; local ones never."""
    wanted = F.array_except(F.array(*map(F.lit, keywords)), F.array(*map(F.lit, local)).cast("array<string>"))
    whole = F.concat(F.lit(" "), F.regexp_replace(text, "[^\\p{L}\\p{N}_]+", " "), F.lit(" "))
    return F.filter(wanted, lambda k: F.when(F.length(k) <= 3, F.contains(whole, F.concat(F.lit(" "), k, F.lit(" ")))).otherwise(F.contains(text, k)))


def register(spark) -> None:
    """SQL names of the keys, as temporary SQL functions that Catalyst inlines."""
    source, target, _ = folds()
    source, target = (x.replace("\\", "\\\\").replace("'", "\\'") for x in (source, target))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION strip_accents(value STRING) RETURNS STRING RETURN translate(lower(value), '{source}', '{target}')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vehicle_lookup_key(value STRING) RETURNS STRING RETURN regexp_replace(replace(strip_accents(value), 'ß', 'ss'), '[^a-z0-9]+', '')")
