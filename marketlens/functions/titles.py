"""Display names of models: titles, generations, body variants, names read out of ad titles, and names that say nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_key
from .unicode import without_accents

# Variants of dashes and apostrophes.
DASHES, APOSTROPHES = "‐‑‒–—―", "’‘´`"
# Words that are written in capitals.
CAPITALS = ("gti", "gtd", "gt", "rs", "st", "ev", "hev", "phev", "suv")
# Words of ad titles that are no model (state, trim and edition).
NOISE = (
    "neuf neuve occasion tbe garantie garantié full options option pack premium edition limited sport line style business confort first life zen "
    "intens intense initiale paris riviera alpine esprit techno evolution iconic rs gt gtline gt-line"
).split()
# Models and makes that say nothing, and names that are no model of a make.
GENERIC_MODELS = ("autres", "autre", "other", "divers", "modele", "marque")
GENERIC_MAKES = ("marque", "autres", "autre", "other", "divers", "unknown", "n/a", "na")
INVALID_MODELS = {
    "volkswagen": ("multivan", "caravelle", "combi", "vw", "volkswagen"),
    "mercedes": ("benz", "mercedes", "mercddes", "mersedes", "mercedes-benz"),
    "audi": ("allroad",),
    "land rover": ("range",),
}


def canonical_text(text: Column) -> Column:
    """Lower-cased without accents; dashes and apostrophes in their plain forms, white space single; dashes stay."""
    plain = F.translate(F.translate(text, DASHES, "-" * len(DASHES)), APOSTROPHES, "'" * len(APOSTROPHES))
    spelt = F.replace(F.lower(plain), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(without_accents(spelt), r"(?U)\s+", " "))


def _word(word: Column) -> Column:
    """One word without dashes or blanks: figures, letters with figures, roman numbers and acronyms in capitals."""
    capitals = word.rlike(r"^[a-z]*[0-9]+[a-z0-9.-]*$") | word.rlike("^[ivxlcdm]+$") | word.isin(*CAPITALS)
    dotted = F.contains(word, F.lit(".")) & F.exists(F.split(word, r"\."), lambda p: p.rlike("^[0-9]+$"))
    return F.when(capitals | dotted, F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30)))


def smart_title(text: Column) -> Column:
    """A display name: each word, and each part of a word with dashes, by the rule of words."""
    words = F.filter(F.split(canonical_text(text), " "), lambda w: w != "")
    whole = lambda w: w.rlike(r"^[a-z]*[0-9]+[a-z0-9.-]*$")
    parts = lambda w: F.array_join(F.transform(F.filter(F.split(w, "-"), lambda p: p != ""), _word), "-")
    return F.array_join(F.transform(words, lambda w: F.when(~whole(w) & F.contains(w, F.lit("-")), parts(w)).otherwise(_word(w))), " ")


def generation_label(model: Column) -> Column:
    """What the first parentheses hold, in capitals; null without any."""
    return F.nullif(F.upper(canonical_text(F.regexp_extract(model, r"\(([^)]+)\)", 1))), F.lit(""))


def without_parentheses(model: Column) -> Column:
    return F.trim(F.regexp_replace(model, r"\([^)]+\)", ""))


def body_variant(generation: Column, model: Column) -> Column:
    """What a model's name adds to the name of its generation; null if nothing."""
    name, prefix = without_parentheses(model), F.trim(generation)
    begins = (prefix != "") & F.startswith(canonical_text(name), canonical_text(prefix))
    rest = F.when(begins, F.regexp_replace(F.substr(name, F.length(prefix) + 1), "^[ -]+|[ -]+$", "")).otherwise(name)
    added = canonical_text(rest) != ""
    same = compact_key(canonical_text(rest)) == compact_key(canonical_text(generation))
    return F.when(added & ~same, smart_title(rest))


def model_from_title(title: Column, make: Column) -> Column:
    """The first word of an ad's title that may be a model: not the make in front, a year, a number or a word of NOISE."""
    whole, name = F.trim(title), F.trim(make)
    rest = F.when(F.startswith(F.lower(whole), F.lower(name)), F.substr(whole, F.length(name) + 1)).otherwise(whole)
    words = F.transform(F.split(F.regexp_replace(rest, r"\b(19|20)\d{2}\b", ""), r"\s+"), lambda w: F.regexp_replace(w, "^[ ,./()-]+|[ ,./()-]+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*NOISE) & ~w.rlike("^[0-9]+$"))
    return F.when((title != "") & (make != ""), F.get(kept, F.lit(0)))


def _bare(text: Column) -> Column:
    return without_accents(F.lower(F.trim(text)))


def is_generic_model(model: Column, make: Column) -> Column:
    """Whether a model says nothing, or is no model of its make (given in its canonical form)."""
    invalid = F.lit(False)
    for known, names in INVALID_MODELS.items():
        invalid = invalid | ((_bare(make) == known) & _bare(model).isin(*names))
    return F.coalesce(_bare(model).isin(*GENERIC_MODELS) | F.coalesce(invalid, F.lit(False)), F.lit(False))


def is_generic_make(make: Column) -> Column:
    return F.coalesce(_bare(make).isin(*GENERIC_MAKES), F.lit(False))
