"""JSON that pages embed: objects in script text, ads and vehicles inside them, and the listings of search results.

Fixed paths are Column expressions on variants or typed JSON. Only two things need Python, both batch-wise in Arrow: the
scanner that cuts balanced objects out of free text (a table function), and the search for a node at an unknown depth,
which gets only rows that the fixed path does not answer.

Defined cases: a null page has no objects and no listings; text that is no JSON is null (what follows a whole JSON value
is not looked at); an object that never closes ends the scan of its text; extra columns of pages are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import compact_key, slug
from ..operators.lookup import first_by

#: A whole string, or what opens or closes; a quote that stands alone is a string without end.
TOKEN = re.compile(r'"(?:[^"\\]+|\\.)*+"|["{}]', re.DOTALL)
#: Levels below which a vehicle is not looked for, and prices of listings (exclusive).
MOST_LEVELS, LOW, HIGH = 12, 500, 500_000
# Path segments before the slug of an ad's URL.
SEGMENTS = "d|angebote|offerte|ofertas|aanbod|offres|annunci|anuncios|oferta|erbjudanden"
SLUG = rf"(?i)/(?:{SEGMENTS})/([a-z0-9][\w-]*?)[-–](?:\d+|[a-f0-9]{{8}}(?:-[a-f0-9]{{4}}){{3}}-[a-f0-9]{{12}}|[a-z0-9]{{6,}})(?:[/?#]|$)"


def objects_in(text: str) -> list[str]:
    """The balanced {...} of a text, outermost ones, in order; quotes count inside of objects only."""
    found, start = [], text.find("{")
    while start >= 0:
        depth, at = 0, start
        while True:
            token = TOKEN.search(text, at)
            if token is None or token[0] == '"':
                return found
            at = token.end()
            depth += {"{": 1, "}": -1}.get(token[0], 0)
            if depth == 0:
                break
        found.append(text[start:at])
        start = text.find("{", at)
    return found


def _scanner(keys: int) -> type:
    """A table function over batches of (keys ..., text): the keys, place and object."""

    class Objects:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            found = [(i, k, x) for i, text in enumerate(rows.column(keys).to_pylist()) for k, x in enumerate(objects_in(text or ""))]
            at = pa.array([f[0] for f in found], pa.int32())
            kept = [rows.column(i).take(at) for i in range(keys)]
            yield pa.Table.from_arrays([*kept, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], names=[*rows.schema.names[:keys], "place", "object"])

    Objects.eval.__annotations__ = {"rows": "pa.RecordBatch", "return": "Iterator[pa.Table]"}
    return Objects


def json_objects(rows: DataFrame, text: str) -> DataFrame:
    """The other columns of rows with place and object, one row for each balanced object of the column text."""
    keep = [c for c in rows.columns if c != text]
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return F.arrow_udtf(_scanner(len(keep)), returnType=f"{kinds}place int, object string")(rows.select(*keep, text).asTable())


def register(spark: SparkSession) -> None:
    """SQL name: SELECT * FROM json_objects(TABLE(SELECT id, text FROM ...)), the id as text."""
    spark.udtf.register("json_objects", F.arrow_udtf(_scanner(1), returnType="id string, place int, object string"))


def nodes(value, most: float = float("inf")) -> Iterator[dict]:
    """The objects of a JSON value in document order, outer ones first, down to ``most`` levels."""
    left = [(value, 0)]
    while left:
        node, depth = left.pop()
        if depth > most or not node:
            continue
        if isinstance(node, dict):
            yield node
        inner = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        left += [(x, depth + 1) for x in reversed(list(inner))]


def is_ad(node: dict) -> bool:
    return "attributes" in node and not node.keys().isdisjoint(("list_id", "ad_id")) and not node.keys().isdisjoint(("price", "subject"))


def is_vehicle(node: dict) -> bool:
    def named(x) -> bool:
        return isinstance(x, str) or isinstance(x, dict) and bool(x.get("name"))

    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    signs = isinstance(node.get("vehicleCategory"), str) or isinstance(node.get("firstRegistrationDate"), str) or number(node.get("price")) or number(node.get("mileage"))
    return named(node.get("make")) and named(node.get("model")) and signs


def _found(text: str | None, accept: Callable[[dict], bool], most: float, finish=None) -> str | None:
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return None
    node = next(filter(accept, nodes(value, most)), None)
    return None if node is None else json.dumps(finish(node, value) if finish else node, ensure_ascii=False)


def _dated(vehicle: dict, whole) -> dict:
    """The vehicle, with the dates of the first node that has a creation time where it has none itself."""
    if vehicle.get("createdDate"):
        return vehicle
    dates = next((n for n in nodes(whole, MOST_LEVELS) if isinstance(n.get("createdDate"), str) and "T" in n["createdDate"]), None)
    if dates is None:
        return vehicle
    changed = dates.get("lastModifiedDate")
    return vehicle | {"createdDate": dates["createdDate"], "lastModifiedDate": vehicle.get("lastModifiedDate") or (changed if isinstance(changed, str) else None)}


@F.arrow_udf(StringType())
def ad_node(texts: pa.Array) -> pa.Array:
    """The first node of a JSON text that looks like an ad, as JSON."""
    return pa.array([_found(x, is_ad, float("inf")) for x in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def vehicle_node(texts: pa.Array) -> pa.Array:
    """The first node of a JSON text that looks like a vehicle, as JSON, with the text's dates."""
    return pa.array([_found(x, is_vehicle, MOST_LEVELS, _dated) for x in texts.to_pylist()], pa.string())


def next_data(html: Column) -> Column:
    """Text of the page's data script; empty without one."""
    return F.regexp_extract(html, r'(?is)<script\s+id="__NEXT_DATA__"\s+type="application/json"[^>]*>(.*?)</script>', 1)


def ad_payload(text: Column) -> Column:
    """The ad of a page's data (JSON text) as a variant: at its fixed path, else the first node that looks like one."""
    whole = F.try_parse_json(text)
    usual = F.try_variant_get(whole, "$.props.pageProps.ad", "variant")
    usual = F.when(F.schema_of_variant(usual).startswith("OBJECT"), usual)
    return F.coalesce(usual, F.try_parse_json(ad_node(F.when(usual.isNull(), text))))


def _string(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _name_of(node: Column, path: str) -> Column:
    """A text, or the name of an object."""
    return F.coalesce(_string(node, f"{path}.name"), F.when(F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "STRING", _string(node, path)))


def slug_score(make: Column, model: Column, url_slug: Column, expected: Column) -> Column:
    """How well make and model match a URL's slug: 2 for the make in front, 1 for just the expected make, 4 for the whole
    model or 2 for one of its words of three letters or more."""
    a, b = slug(make), slug(model)
    words = F.filter(F.split(b, "-"), lambda t: F.length(t) >= 3)
    model_score = F.when(F.contains(url_slug, b), 4).when(F.exists(words, lambda t: F.contains(url_slug, t)), 2).otherwise(0)
    return (
        F.when((a != "") & F.startswith(url_slug, a), 2).otherwise(0)
        + F.when(expected.isNotNull() & (slug(expected) != "") & (a == slug(expected)), 1).otherwise(0)
        + F.when(b != "", model_score).otherwise(0)
    )


def page_vehicles(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, vehicle, score, candidates): of the vehicles in a page's scripts the one that its URL names best.

    Equal scores, and pages without a slug, go to the last one. pages has url and html.
    """
    # What the URL says is read once for a page, not for each of its vehicles.
    slug_of = F.regexp_extract("url", SLUG, 1)
    named = {"_slug": F.lower(slug_of), "_make": F.upper(F.get(F.filter(F.split(slug_of, "-"), lambda t: t != ""), F.lit(0)))}
    scripts = evaluated(pages, [page_id, "html"], named).select(page_id, *named, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1)).alias("script", "text"))
    wanted = lambda c: F.contains(c, F.lit("vehicleCategory")) | F.contains(c, F.lit("firstRegistrationDate"))
    text, keep = F.col("text"), F.lit("\u0001")
    # Streamed scripts escape their quotes twice, or once.
    twice = F.replace(F.replace(F.replace(text, F.lit('\\\\\\"'), keep), F.lit('\\\\"'), F.lit('"')), keep, F.lit('\\"'))
    sources = F.when(F.contains(text, F.lit("self.__next_f")), F.array(twice, F.replace(text, F.lit('\\"'), F.lit('"')))).otherwise(F.array(text))
    sources = scripts.where(wanted(text)).select(page_id, *named, "script", F.posexplode(sources).alias("source", "text"))
    objects = json_objects(sources, "text").where(F.contains("object", F.lit('"vehicleCategory"')) | F.contains("object", F.lit('"firstRegistrationDate"')))
    found = evaluated(objects.withColumn("object", vehicle_node("object")), [page_id, *named, "script", "source", "place"], {"vehicle": F.try_parse_json("object")}).where("vehicle is not null")
    names = {"make": _name_of(F.col("vehicle"), "$.make"), "model": _name_of(F.col("vehicle"), "$.model")}
    found = evaluated(found, [page_id, *named, "script", "source", "place", "vehicle"], names)
    score = F.when(F.col("_slug") != "", slug_score(F.col("make"), F.col("model"), F.col("_slug"), F.col("_make"))).otherwise(0)
    found = evaluated(found, [page_id, "vehicle"], {"order": F.struct(score.alias("score"), "script", "source", "place")})
    return found.groupBy(page_id).agg(F.max_by("vehicle", "order").alias("vehicle"), F.max("order.score").alias("score"), F.count(F.lit(1)).alias("candidates"))


def vehicle_fields(vehicle: Column) -> dict[str, Column]:
    return {
        "make": _name_of(vehicle, "$.make"),
        "model": _name_of(vehicle, "$.model"),
        "price": F.try_variant_get(vehicle, "$.price", "long"),
        "mileage": F.try_variant_get(vehicle, "$.mileage", "long"),
        "created": _string(vehicle, "$.createdDate"),
    }


# Listings of search results.

LISTINGS = "props struct<pageProps: struct<listings: array<struct<id: string, tracking: struct<price: string, mileage: string, firstRegistration: string>, vehicle: struct<make: string, fuel: string, transmission: string>, vehicleDetails: array<struct<ariaLabel: string, iconName: string, data: string>>>>>>"


def leading_int(text: Column) -> Column:
    """The whole number that a text begins with; 0 is null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def evaluated(rows: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """The columns keep and the fields, each field worked out once for a row.

    A filter after a projection would move below it and work out the fields again wherever it reads them; it does not
    move below a generator.
    """
    return rows.select(*keep, F.array(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("_fields")).select(*keep, F.inline_outer("_fields"))


def _listed(rows: DataFrame, page_id: str, target: str) -> DataFrame:
    """Listings of plausible price and the target's make (unknown makes pass), the first of each uid or (price, km)."""
    unknown = F.nullif("brand", F.lit("")).isNull()
    key = F.coalesce("uid", F.concat_ws("-", F.col("price").cast("string"), F.coalesce(F.col("km").cast("string"), F.lit("null"))))
    plausible = rows.where((F.col("price") > LOW) & (F.col("price") < HIGH))
    kept = [c for c in rows.columns if c not in ("brand", target)]
    named = evaluated(plausible, kept, {"_brand": F.when(~unknown, compact_key(F.col("brand"))), "_target": F.when(~unknown, compact_key(F.col(target))), "key": key})
    fits = named.where(F.coalesce(F.contains("_brand", "_target") | F.contains("_target", "_brand"), F.lit(True)))
    return first_by(fits.drop("_brand", "_target"), [page_id, "key"], F.col("place")).drop("key")


def data_listings(pages: DataFrame, page_id: str = "page_id", target: str = "target_make") -> DataFrame:
    """(page_id, place, uid, price, km, year, fuel, gearbox, hp) from pages' data scripts; pages has html and target."""
    data = F.from_json(next_data(F.col("html")), LISTINGS)
    rows = pages.select(page_id, target, F.posexplode(data["props"]["pageProps"]["listings"]).alias("place", "x"))
    power = F.filter("x.vehicleDetails", lambda d: (d["ariaLabel"] == "Leistung") | (d["iconName"] == "speedometer"))
    fields = {
        "uid": F.nullif("x.id", F.lit("")),
        "price": leading_int(F.col("x.tracking.price")),
        "km": leading_int(F.col("x.tracking.mileage")),
        "year": F.regexp_extract("x.tracking.firstRegistration", r"(\d{4})", 1).try_cast("int"),
        "fuel": F.nullif("x.vehicle.fuel", F.lit("")),
        "gearbox": F.nullif("x.vehicle.transmission", F.lit("")),
        "hp": F.regexp_extract(F.get(power, F.lit(0))["data"], r"(?i)\((\d+)\s*PS\)", 1).try_cast("int"),
        "brand": F.col("x.vehicle.make"),
    }
    return _listed(evaluated(rows, [page_id, target], {"place": F.col("place").cast("int"), **fields}), page_id, target)


def catalogue_items(node: Column, levels: int = 3) -> Column:
    """Items of the offer catalogue of a JSON-LD variant: the node itself, its (or its main entity's) offers, or the first
    node of its graph that has some, graphs inside of graphs included."""
    is_catalogue = lambda path: _string(node, f"{path}['@type']") == "OfferCatalog"
    items = lambda path: F.try_variant_get(node, f"{path}.itemListElement", "array<variant>")
    main = F.try_variant_get(node, "$.mainEntity.offers", "variant").isNotNull()
    found = F.when(is_catalogue("$"), items("$"))
    found = F.coalesce(found, F.when(main & is_catalogue("$.mainEntity.offers"), items("$.mainEntity.offers")).when(~main & is_catalogue("$.offers"), items("$.offers")))
    if levels:
        graph = F.try_variant_get(node, "$['@graph']", "array<variant>")
        found = F.coalesce(found, F.get(F.filter(F.transform(graph, lambda n: catalogue_items(n, levels - 1)), lambda a: F.size(a) > 0), F.lit(0)))
    return found


def _number(node: Column, path: str) -> Column:
    """A number, or the whole number that a text begins with."""
    return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "STRING", leading_int(_string(node, path))), F.try_variant_get(node, path, "double").cast("int"))


def catalogue_listings(pages: DataFrame, page_id: str = "page_id", target: str = "target_make") -> DataFrame:
    """(page_id, place, uid, price, km, year, fuel) from pages' JSON-LD offer catalogues; pages has html and target."""
    blocks = pages.select(page_id, target, F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)).alias("block", "text"))
    # Only a text that holds the type's name, or escapes that may spell it, can hold a catalogue.
    blocks = blocks.where(F.contains("text", F.lit("OfferCatalog")) | F.contains("text", F.lit("\\u")))
    rows = blocks.withColumn("data", F.try_parse_json("text")).select(page_id, target, "block", F.posexplode(catalogue_items(F.col("data"))).alias("at", "item"))
    item = F.col("item")
    car = F.coalesce(F.try_variant_get(item, "$.offers.itemOffered", "variant"), item)
    rows = rows.withColumn("car", car)
    car = F.col("car")
    date = F.substring(F.coalesce(_string(car, "$.vehicleModelDate"), _string(car, "$.productionDate")), 1, 4).try_cast("int")
    url = F.coalesce(F.nullif(_string(item, "$.url"), F.lit("")), _string(item, "$.offers.url"))
    digits = F.regexp_extract(url, r"(\d{6,})(?:[/?#]|$)", 1)
    fields = {
        "uid": F.coalesce(F.nullif(digits, F.lit("")), F.nullif(url, F.lit(""))),
        "price": F.coalesce(_number(item, "$.offers.price"), _number(item, "$.price")),
        "km": F.coalesce(_number(car, "$.mileageFromOdometer.value"), _number(car, "$.mileageFromOdometer")),
        "year": F.when((date > 1900) & (date < 2100), date),
        "fuel": F.coalesce(_string(car, "$.vehicleEngine.fuelType"), _string(car, "$.vehicleEngine[0].fuelType")),
        "brand": F.coalesce(_string(item, "$.brand.name"), _string(item, "$.offers.itemOffered.brand.name"), _string(item, "$.manufacturer"), _string(item, "$.offers.itemOffered.manufacturer")),
    }
    return _listed(evaluated(rows, [page_id, target], {"place": (F.col("block") * 100_000 + F.col("at")).cast("int"), **fields}), page_id, target)
