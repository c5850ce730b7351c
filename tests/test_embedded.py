"""Objects in free text, ads and vehicles at unknown depths, and listings of result pages, on small pages."""

import json

import pytest
from pyspark.sql import functions as F

from marketlens.sources import embedded


@pytest.mark.parametrize(
    "text, found",
    [
        ("", []),
        ("no object", []),
        ('a {"b": 1} c {"d": {"e": 2}}{}', ['{"b": 1}', '{"d": {"e": 2}}', "{}"]),
        ('{"b": "}{", "c": "\\"}"} x', ['{"b": "}{", "c": "\\"}"}']),
        ('it\'s "quoted {"b": 1}', ['{"b": 1}']),
        ('{"a": 1} {"never closes": {"b": 2}', ['{"a": 1}']),
        ('{"a": 1} {"no end of string: }', ['{"a": 1}']),
        ("{" * 5000 + "}" * 5000, ["{" * 5000 + "}" * 5000]),
    ],
)
def test_objects_in(text, found):
    assert embedded.objects_in(text) == found


def test_table_function(spark):
    rows = spark.createDataFrame([(1, "x", '{"a":1} {"b":{}}', 9), (2, None, None, 9), (3, "z", "none", 9), (None, "w", "{}", 9)], "id long, place_name string, text string, other int")
    found = {tuple(r) for r in embedded.json_objects(rows, "text").collect()}
    assert found == {(1, "x", 9, 0, '{"a":1}'), (1, "x", 9, 1, '{"b":{}}'), (None, "w", 9, 0, "{}")}
    embedded.register(spark)
    rows.createOrReplaceTempView("texts")
    assert spark.sql("SELECT object FROM json_objects(TABLE(SELECT CAST(id AS STRING), text FROM texts)) WHERE id = '1'").count() == 2


def test_nodes_end_at_a_depth():
    value = {"a": [{"b": {"c": 1}}], "d": {}}
    assert list(embedded.nodes(value)) == [value, {"b": {"c": 1}}, {"c": 1}]
    assert list(embedded.nodes(value, 2)) == [value, {"b": {"c": 1}}]
    deep = {"make": "m", "model": {"name": "x"}, "price": 1}
    for _ in range(2000):
        deep = {"x": deep}
    assert embedded._found(json.dumps({"x": {"make": "m", "model": "x", "price": True}}), embedded.is_vehicle, 12) is None


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, target_make string, place int")


CAR = {"make": "Brand", "model": "Hatch Long", "vehicleCategory": "car", "price": 100}
OTHER = {"make": {"name": "Other"}, "model": {"name": "Wagon"}, "firstRegistrationDate": "x", "mileage": 7}


def test_vehicles_of_pages(spark):
    script = lambda *x: "".join(f"<script>{t}</script>" for t in x)
    once = "self.__next_f.push([1,\"" + json.dumps({"deep": [{"v": CAR}], "t": {"createdDate": "2001-01-01T00:00"}}).replace('"', '\\"') + "\"])"
    rows = [
        (1, "https://x/angebote/brand-hatch-12345?y", script(json.dumps({"v": CAR}), json.dumps({"v": OTHER})), None, 0),
        (2, "https://x/nothing", script(json.dumps({"v": CAR}), json.dumps({"v": OTHER})), None, 0),
        (3, None, script(once), None, 0),
        (4, "https://x/d/other-thing-abcdef", script("var x = " + json.dumps([OTHER, CAR])), None, 0),
        (5, "https://x/d/other-thing-abcdef", script("firstRegistrationDate {broken", '{"firstRegistrationDate": tru}'), None, 0),
        (6, None, None, None, 0),
    ]
    found = embedded.page_vehicles(pages_of(spark, rows))
    fields = embedded.vehicle_fields(F.col("vehicle"))
    got = {r[0]: tuple(r)[1:] for r in found.select("page_id", *[fields[k].alias(k) for k in ("make", "model", "price", "mileage", "created")], "score").collect()}
    assert got == {
        1: ("Brand", "Hatch Long", 100, None, None, 5),  # make in front and as expected, one word of the model
        2: ("Other", "Wagon", None, 7, None, 0),
        3: ("Brand", "Hatch Long", 100, None, "2001-01-01T00:00", 0),
        4: ("Other", "Wagon", None, 7, None, 3),  # an array is cut into its objects
    }


def test_ads_at_any_depth(spark):
    ad = {"list_id": 5, "subject": "s", "attributes": []}
    data = [json.dumps(x) for x in ({"props": {"pageProps": {"ad": ad}}}, {"a": [[{"attributes": []}, {"b": ad}]]}, {"props": {"pageProps": {"ad": 3}}}, [])] + ["{", None, ""]
    rows = spark.createDataFrame(list(enumerate(data)), "id int, data string")
    got = {r[0]: r[1] for r in rows.select("id", F.try_variant_get(embedded.ad_payload(F.col("data")), "$.list_id", "int")).collect()}
    assert got == {0: 5, 1: 5, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_listings(spark):
    listing = lambda price, **x: {"tracking": {"price": price, "mileage": "10"}, "vehicle": {"make": "B"}} | x
    data = {"props": {"pageProps": {"listings": [listing("600"), listing("600"), listing(700, id="u"), listing("800 x", id="u"), listing("500"), listing("500000"), listing("900", vehicle={"make": "Z"}), listing("901", vehicle={}), {"tracking": None}]}}}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'
    rows = pages_of(spark, [(1, None, html, "b", 3), (2, None, "<script></script>", "b", 3), (3, None, None, None, None), (4, None, html.replace("}]", "}"), "b", 3)])
    assert sorted((r["place"], r["price"], r["uid"]) for r in embedded.data_listings(rows).collect()) == [(0, 600, None), (2, 700, "u"), (7, 901, None)]
    item = {"offers": {"price": "1500", "itemOffered": {"mileageFromOdometer": "12 km", "productionDate": 1850}}, "url": "/x"}
    graph = {"@graph": [{"@graph": [{"offers": {"@type": "OfferCatalog", "itemListElement": []}}, {"@type": "OfferCatalog", "itemListElement": [item, item]}]}]}
    html = f'<script type="application/ld+json">nothing</script><script type="application/ld+json">{json.dumps(graph)}</script>'
    (r,) = embedded.catalogue_listings(pages_of(spark, [(1, None, html, None, 0)])).collect()
    assert (r["uid"], r["price"], r["km"], r["year"], r["fuel"]) == ("/x", 1500, 12, None, None)


def _filters_of(rows):
    return [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter " in line]


def test_fields_are_not_worked_out_again_in_filters(spark):
    pages = spark.createDataFrame([(1, "Kia", "https://x.example/d/kia-rio-12345678", "<p>")], "page_id long, target_make string, url string, html string")
    for found in (embedded.catalogue_listings(pages), embedded.data_listings(pages), embedded.page_vehicles(pages)):
        assert not any(x in line for line in _filters_of(found) for x in ("variant", "regexp", "_folded"))
