"""Filters that read texts and phone numbers: the number's plan, signs of an import, and spreads of reference prices.

Words are searched one by one, as bytes: a pattern of alternatives tries each of them at each place. Defined cases: null texts mention nothing; a null country
is the home country; a phone of blanks counts as none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_case, weighed

HOME = "FR"
# Prefixes reserved for telephone sales, and those of second, virtual numbers.
SALES_PREFIXES = "0162 0163 0270 0271 0377 0378 0424 0425 0568 0569 0948 0949 09475 09476 09477 09478 09479".split()
VIRTUAL_PREFIXES = "064466 064467 064468 064469 07568 07569".split()
# Numbers of mobile and fixed networks by country, after the trunk or country prefix.
PLANS = {"FR": ("+33", "[1-7][0-9]{8}|9[0-9]{8}"), "CH": ("+41", "7[5-9][0-9]{7}|[2-6][0-9]{8}"), "DE": ("+49", "1[5-7][0-9]{8,9}|[2-9][0-9]{6,10}")}
# Words of imports, and countries that cars come from.
IMPORT_WORDS = [
    "importé", "importee", "importation", "etranger", "étranger", "étrangère", "etrangere", "provenance", "en provenance", "dédouané", "dedouane", "dédouanement", "dedouanement",
    "quitus fiscal", "compteur en miles", "volant a droite", "volant à droite",
]
WHOLE_IMPORT_WORDS = ["import"]
COUNTRIES = ["allemagne", "belgique", "espagne", "italie", "pologne", "roumanie", "pays-bas", "hollande", "portugal", "luxembourg", "autriche", "suisse", "bulgarie", "republique tcheque", "slovaquie", "hongrie", "croatie"]
OWN_NAMES = {"CH": ["suisse"], "DE": ["allemagne"], "AT": ["autriche"], "IT": ["italie"], "NL": ["pays-bas", "hollande"], "BE": ["belgique"], "LU": ["luxembourg"], "ES": ["espagne"]}
# Words of ads in other languages; on the sites of their own countries they are usual.
GERMAN = "unfallwagen fahrzeug kilometerstand gebraucht automatik schaltgetriebe erstbesitzer unfallfrei erstzulassung hubraum getriebe kraftstoff vorbesitzer scheckheftgepflegt hauptuntersuchung".split()
SPANISH = ["vehículo", "vehiculo", "kilómetros", "kilometros", "cambio manual", "gasolina", "propietario", "matriculación", "matriculacion"]
ITALIAN = ["veicolo", "chilometri", "cambio automatico", "cambio manuale", "benzina", "proprietario", "immatricolazione", "primo proprietario", "km certificati"]
ENGLISH = ["left hand drive", "lhd", "imported from"]
ALWAYS_FOREIGN = ["einfuhr", "importiert", "verzollt", "importado", "aduana", "importato", "dogana"]
OWN_LANGUAGE = {"CH": GERMAN, "DE": GERMAN, "AT": GERMAN, "ES": SPANISH, "IT": ITALIAN}
# Words of taxes and of registrations, clear ones and doubtful ones.
TAX_WORDS = ["exportation", "malus payé", "malus paye", "malus ecologique", "malus écologique", "malus inclus", "taxe co2"]
REGISTRATION, WHOLE_REGISTRATION = ["plaque ww", "immatriculation ww", "certificat de conformite", "reception a titre isole"], ["coc", "rti"]
DOUBTFUL_REGISTRATION = ["carte grise en cours", "carte grise a faire", "plaque provisoire", "homologation"]
#: A car younger than so many years is too cheap below so much.
YOUNG_YEARS, TOO_CHEAP = 8, 3000


def mentions(text: Column, words: list[str], whole: list[str] = ()) -> Column:
    """Whether a lower-cased text holds one of words anywhere, or one of whole between other than letters and digits."""
    holds = lambda some: F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(text, w))
    found = holds(words)
    if whole:  # the pattern is only tried on texts that hold its words at all
        found = found | (holds(whole) & text.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(map(re.escape, whole))})(?![\p{{L}}\p{{N}}_])"))
    return F.coalesce(found, F.lit(False))


def phone_plan(number: Column, dialled: Column, country: Column, owner: Column, has_phone: Column, site_hides: Column) -> Column:
    """A seller's number: none at all warns (a professional's fails) unless the site hides it; a foreign prefix warns;
    numbers of telephone sales fail, virtual ones warn, others pass, the more surely the better their plan is known.

    number is text.phone_digits of the phone, dialled text.country_of_number of that: columns of their own, as many rules
    read them.
    """
    land = F.upper(F.coalesce(country, F.lit(HOME)))
    none = F.coalesce(number, F.lit("")) == ""
    private = F.lower(F.coalesce(owner, F.lit(""))).isin("private", "particulier", "")
    home = lambda prefixes: number.rlike(rf"^(?:\+33|0)(?:{'|'.join(p[1:] for p in prefixes)})")
    known = F.lit(False)
    for name, (code, plan) in PLANS.items():
        known = known | ((land == name) & number.rlike(rf"^(?:\{code}|0)(?:{plan})$"))
    cases = [
        (none & (F.coalesce(site_hides, F.lit(False)) | F.coalesce(has_phone, F.lit(False))), "neutral", 0.0),
        (none & private, "warning", 0.2),
        (none, "fail", 0.0),
        (dialled != land, "warning", 0.3),
        ((land == HOME) & home(SALES_PREFIXES), "fail", 0.1),
        ((land == HOME) & home(VIRTUAL_PREFIXES), "warning", 0.3),
        (known, "pass", 1.0),
        (~land.isin(*PLANS) & dialled.isNull() & ~F.startswith(number, F.lit("+")), "pass", 0.7),
        (F.lit(True), "pass", 0.8),
    ]
    return first_case(cases, number)


def import_weight(text: Column, country: Column, dialled: Column, price: Column, age: Column, is_pro: Column, number: Column, checked_site: Column) -> Column:
    """Weight of the signs of an import: foreign phone, words of imports, countries, foreign words, taxes and registrations,
    a price far too low for the age, a professional without a number; doubtful registrations weigh a half.

    text is the lower-cased title and description, dialled the phone's country; rules.imported_by judges the weight.
    """
    land = F.upper(F.coalesce(country, F.lit(HOME)))

    def elsewhere(words: list[str], own: dict[str, list[str]]) -> Column:
        """Mentions of words without those that are usual in the ad's own country."""
        usual = sorted({w for names in own.values() for w in names})
        found = mentions(text, [w for w in words if w not in usual])
        # The few words that are usual somewhere are looked for one country's list at a time.
        rest = None
        for names in {tuple(v) for v in own.values()}:
            where = [k for k, v in own.items() if tuple(v) == names]
            hit = ~land.isin(*where) & mentions(text, list(names))
            rest = hit if rest is None else rest | hit
        return found | rest

    strong = [
        dialled != land,
        mentions(text, IMPORT_WORDS, WHOLE_IMPORT_WORDS),
        elsewhere(COUNTRIES, OWN_NAMES),
        elsewhere([*GERMAN, *SPANISH, *ITALIAN, *ENGLISH, *ALWAYS_FOREIGN], OWN_LANGUAGE),
        mentions(text, TAX_WORDS),
        mentions(text, REGISTRATION, WHOLE_REGISTRATION),
        (age < YOUNG_YEARS) & (price < TOO_CHEAP),
        is_pro & (F.coalesce(number, F.lit("")) == "") & ~F.coalesce(checked_site, F.lit(False)),
    ]
    return weighed(strong, [mentions(text, DOUBTFUL_REGISTRATION)])


def reference_prices(offers: Column, fuel: Column, hp_range: Column, least_samples: int = 3, least: int = 3) -> Column:
    """Prices to compare with: minima, medians and maxima of the narrowest offers that give at least ``least`` of them.

    Offers of the ad's fuel first, then of any; of its power range, then without one, then of any.
    """
    same_fuel, power = lambda o: F.coalesce(F.lower(o["fuel"]) == F.lower(fuel), F.lit(False)), lambda o: F.lower(o["hp_range"]) == F.lower(hp_range)
    powers = [lambda o: F.coalesce(power(o), F.lit(False)), lambda o: o["hp_range"].isNull(), lambda o: F.lit(True)]
    tests = [(lambda o, p=p, f=f: f(o) & p(o)) for f in (same_fuel, lambda o: F.lit(True)) for p in powers]

    def prices(keep) -> Column:
        kept = F.filter(offers, lambda o: (o["sample_count"] >= least_samples) & keep(o))
        three = F.flatten(F.transform(kept, lambda o: F.array(*[F.nullif(o[c].cast("double"), F.lit(0.0)) for c in ("price_min", "price_median", "price_max")])))
        return F.array_compact(three)

    return F.coalesce(*[F.when(F.size(p) >= least, p) for p in map(prices, tests)])


def moments(values: Column) -> Column:
    """Mean, population deviation and number of an array of doubles, in one pass."""
    n = F.size(values)
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"))
    sums = F.aggregate(values, start, lambda a, v: F.struct((a["x"] + v).alias("x"), (a["xx"] + v * v).alias("xx")), lambda a: F.struct((a["x"] / n).alias("mean"), F.sqrt(F.greatest(a["xx"] / n - a["x"] / n * a["x"] / n, F.lit(0.0))).alias("deviation"), n.cast("long").alias("n")))
    return F.when(n > 0, sums)
