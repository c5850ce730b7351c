"""Rule filters over ads, each one a struct column (status, score, detail); all are evaluated in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import DEFAULT_KM_A_YEAR, KM_A_YEAR, uid_is_valid

# Weight of each filter in the score.
WEIGHTS = {"L1": 1.0, "L2": 2.0, "L3": 1.5, "L4": 2.0, "L5": 1.5, "L6": 0.5, "L7": 1.0, "L8": 1.0, "L9": 1.5, "L10": 1.0, "L11": 1.0}


def result(status: Column, score: Column, detail: Column) -> Column:
    """A filter's result; scores have two digits (a computed one is rounded by its filter, as rounding takes long)."""
    return F.struct(status.alias("status"), score.cast("double").alias("score"), detail.cast("string").alias("detail"))


def first_case(cases: list[tuple[Column, str, float]], detail: Column) -> Column:
    """The result of the first (condition, status, score) that holds; each condition is evaluated once at most."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), result(F.lit(status), F.lit(score), detail)) for c, status, score in cases])


def _count(flags: list[Column]) -> Column:
    return sum((F.coalesce(x, F.lit(False)).cast("int") for x in flags), F.lit(0))


def completeness(critical: list[Column], secondary: list[Column]) -> Column:
    """Share of values present; three critical ones missing fail, one warns, a secondary one warns."""
    a, b = _count([c.isNull() for c in critical]), _count([c.isNull() for c in secondary])
    n = len(critical) + len(secondary)
    status = F.when(a >= 3, "fail").when((a >= 1) | (b >= 1), "warning").otherwise("pass")
    return result(status, F.round((n - a - b) / F.lit(float(n)), 2), a + b)


def known_model(make: Column, model: Column, generic: Column, known: Column) -> Column:
    """Without make or model, or with a generic model, nothing is said; a model that is not known warns."""
    status = F.when(make.isNull() | model.isNull() | generic, "skip").when(known, "pass").otherwise("warning")
    return result(status, F.when(status == "pass", 1.0).when(status == "warning", 0.3).otherwise(0.0), model)


def km_a_year(category: Column) -> Column:
    """Kilometres a year that a category of vehicle is expected to do."""
    pairs = F.create_map(*[F.lit(x) for item in KM_A_YEAR.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, category), F.lit(DEFAULT_KM_A_YEAR))


def mileage(km: Column, year: Column, now_year: Column, price: Column, category: Column, is_pro: Column) -> Column:
    """Mileage against what age and category let expect, and bounds of the price: one oddity warns, two fail, a future
    year fails. Sports cars with few kilometres, nearly new cars and professional sellers weigh less."""
    age, pro, sporty = now_year - year, F.coalesce(is_pro, F.lit(False)), F.coalesce(category == "sportive", F.lit(False))
    expected = age * km_a_year(category)
    ratio = F.when(expected > 0, km / F.nullif(expected, F.lit(0))).otherwise(F.when(km < 20000, 1.0).otherwise(2.0))

    fresh, odd = (age <= 1) & (km < 1000), _count([ratio < 0.5, ratio > 1.5, (price < 500) | (price > 100000)])
    # A nearly new car of a professional is named before the professional's high mileage.
    mild = F.when(sporty & (ratio < 0.5), 0.85).when(fresh & pro, 0.7).when(fresh, 0.65).when(pro & (ratio > 1.5) & (ratio < 2.5), 0.6).otherwise(0.5)
    known = km.isNotNull() & year.isNotNull()
    status = F.when(~known, "skip").when((age < 0) | (odd >= 2), "fail").when(odd == 1, "warning").otherwise("pass")
    score = F.when(~known | (age < 0), 0.0).when(odd == 0, 1.0).when(odd == 1, mild).otherwise(0.2)
    return result(status, score, F.round(ratio, 2))


def registered(owner: Column, number: Column, country: Column, verified: Column, rating: Column, reviews: Column, state: Column | None) -> Column:
    """A seller's entry in the company registry. state is A for active, another text for closed, null for not found;
    without a registry (state is None) French numbers say nothing, and Swiss ones pass by their checksum."""
    no_id = number.isNull()
    pro = F.coalesce(owner.isin("pro", "professional"), F.lit(False))
    rated = F.coalesce((rating >= 4.0) & (reviews >= 20), F.lit(False))
    digits = F.regexp_replace(number, "[^0-9]", "")
    swiss = F.coalesce(country == "CH", F.lit(False))
    valid = F.when(swiss, uid_is_valid(digits)).otherwise(F.regexp_replace(number, r"[\s.-]", "").rlike("^([0-9]{9}|[0-9]{14})$"))
    cases = [
        (F.coalesce(owner.isin("private", "particulier"), F.lit(False)), "neutral", 0.0),
        (no_id & pro & verified, "pass", 1.0),
        (no_id & pro & rated, "pass", 0.7),
        (no_id & pro, "warning", 0.3),
        (no_id, "skip", 0.0),
        (~valid, "fail", 0.1),
    ]
    if state is None:
        cases += [(swiss, "pass", 0.7), (F.lit(True), "skip", 0.0)]
    else:
        cases += [(state.isNull(), "fail", 0.1), (state == "A", "pass", 0.9), (F.lit(True), "warning", 0.4)]
    return first_case(cases, number)


def weighed(strong: list[Column], weak: list[Column]) -> Column:
    """Weight of signs: a strong one weighs 1, a weak one a half."""
    return _count(strong) + 0.5 * _count(weak)


def imported(strong: list[Column], weak: list[Column]) -> Column:
    """Signs of an import by their weight."""
    return imported_by(weighed(strong, weak))


def imported_by(weight: Column) -> Column:
    """Signs of an import: from a weight of 1 on they warn, from 2 on they fail."""
    status = F.when(weight < 1, "pass").when(weight < 2, "warning").otherwise("fail")
    return result(status, F.when(weight < 1, 1.0).when(weight < 2, 0.4).otherwise(0.1), weight)


def price_gap(price: Column, reference: Column) -> Column:
    """Distance from the reference price in percent: up to 10 passes, up to 25 warns."""
    gap = F.abs(100.0 * (price - reference) / reference)
    status = F.when(reference.isNull() | (reference == 0) | price.isNull(), "skip").when(gap <= 10, "pass").when(gap <= 25, "warning").otherwise("fail")
    score = F.when(status == "pass", 1.0).when(status == "warning", 0.5).when(status == "fail", 0.1).otherwise(0.0)
    return result(status, score, F.round(gap, 1))


def phone(country: Column, home: Column, present: Column) -> Column:
    """A foreign prefix warns; without a phone nothing is said."""
    status = F.when(~present, "neutral").when(country.isNotNull() & (country != home), "warning").otherwise("pass")
    return result(status, F.when(status == "pass", 1.0).when(status == "warning", 0.3).otherwise(0.0), country)


def strengths(good: list[Column], bad: list[Column]) -> Column:
    """Share of good signs among good and bad ones, a half without any; no bad one passes, one warns, more fail. Signs
    that are neither are left out of both lists."""
    strong, weak = _count(good), _count(bad)
    status = F.when(weak == 0, "pass").when(weak == 1, "warning").otherwise("fail")
    return result(status, F.round(F.coalesce(strong / F.nullif(strong + weak, F.lit(0)), F.lit(0.5)), 2), weak)


def presentation(description: Column, owner: Column, images: Column, paid: list[Column], phone: Column, city: Column, area: Column) -> Column:
    """How well an ad presents itself: text, seller, photos, paid options, phone and place."""
    length, photos = F.length(F.trim(F.coalesce(description, F.lit("")))), F.coalesce(images, F.lit(0))
    some_option = F.greatest(*[F.coalesce(x, F.lit(False)) for x in paid]) if len(paid) > 1 else paid[0]
    good = [length >= 200, owner == "pro", photos > 3, some_option, phone.isNotNull() & (phone != ""), city.isNotNull() & (city != "")]
    return strengths(good, [length < 50, photos == 0, city.isNull() & area.isNull()])


def listing_age(days: Column, price: Column, median_days: Column | None = None, republished: Column | None = None) -> Column:
    """Days online against the market's median, or against bands of the price; republished ads that are late weigh more."""
    bands = F.when(price.isNull(), 35).when(price < 10000, 21).when(price < 25000, 35).when(price < 50000, 50).otherwise(75)
    ratio = days / (bands if median_days is None else F.when(median_days > 0, median_days).otherwise(bands))
    again = F.lit(False) if republished is None else F.coalesce(republished, F.lit(False))
    status = F.when(days.isNull(), "skip").when(ratio <= 1, "pass").when(again & (ratio > 2), "fail").otherwise("warning")
    late = F.when(ratio <= 2, F.when(again, 0.4).otherwise(0.5)).otherwise(F.when(again, 0.2).otherwise(0.3))
    return result(status, F.when(days.isNull(), 0.0).when(ratio <= 0.3, 1.0).when(ratio <= 1, 0.8).otherwise(late), F.round(ratio, 2))


def recalled(ads: DataFrame, recalls: DataFrame, keys: list[str], ad_id: str, label: str | None = None) -> DataFrame:
    """(ad, n_recalls, first_recall, status, score): recalls (keys, year_start, year_end) that hold in the ad's year, the
    smallest label of them; a missing year is neutral. Recalls are counted once for each key and year, not for each ad."""
    name = F.col(label) if label else F.concat_ws("-", "year_start", "year_end")
    held = ads.select(*keys, "year").distinct().join(recalls, keys).where(F.col("year").between(F.col("year_start"), F.col("year_end")))
    hit = held.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n_recalls"), F.min(name).alias("first_recall"))
    out = ads.select(ad_id, *keys, "year").join(hit, [*keys, "year"], "left").withColumn("n_recalls", F.coalesce("n_recalls", F.lit(0)))
    status = F.when(F.col("year").isNull(), "neutral").when(F.col("n_recalls") > 0, "fail").otherwise("pass")
    return out.select(ad_id, "n_recalls", "first_recall", status.alias("status"), (status == "pass").cast("double").alias("score"))


def price_spread(price: Column, mean: Column, deviation: Column, n: Column, diesel: Column, urban: Column, km: Column) -> Column:
    """Distance of a price from its references in deviations: beyond 2 warns, beyond 3 fails; a diesel of an urban region
    with some kilometres warns too. Without price or with fewer than three references nothing is said."""
    z = F.abs((price - mean) / F.nullif(deviation, F.lit(0.0)))
    far, worn = F.coalesce(z > 2, F.lit(False)), F.coalesce(diesel & urban & (km > 30000), F.lit(False))
    status = F.when(price.isNull() | (F.coalesce(n, F.lit(0)) < 3), "skip").when(F.coalesce(z > 3, F.lit(False)), "fail").when(far | worn, "warning").otherwise("pass")
    score = F.when(status == "pass", 1.0).when(status == "warning", 0.5).when(status == "fail", 0.2).otherwise(0.0)
    return result(status, score, F.round(z, 2))


def side_by_side(**filters: Column) -> Column:
    """All filters' results within the row: an array of (filter_id, status, score, detail, weight), by filter."""
    number = lambda name: int(name[1:])
    return F.array(*[F.struct(F.lit(name).alias("filter_id"), *[c[x].alias(x) for x in ("status", "score", "detail")], F.lit(WEIGHTS.get(name, 1.0)).alias("weight")) for name, c in sorted(filters.items(), key=lambda x: number(x[0]))])


def run_all(ads: DataFrame, ad_id: str, **filters: Column) -> DataFrame:
    """Long results (ad, filter_id, status, score, detail, weight) of all filters, evaluated side by side."""
    return ads.select(ad_id, F.explode(side_by_side(**filters)).alias("x")).select(ad_id, "x.*")
