"""Queries for accents, display names and names that say nothing; SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, titles, unicode
from ..session import table
from .queries import query


@query("SELECT doc_id, md5(strip_accents(text)) AS bare_md5, md5(regexp_replace(trim(regexp_replace(translate(strip_accents(text), '’‘', ''''''), '\\s+', ' ', 'g')), '--+', '-', 'g')) AS market_md5 FROM documents")
def str_no_accents(spark, sf_dir):  # STR1 STR2
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(unicode.without_accents(c).cast("binary")).alias("bare_md5"), F.md5(text.market_form(c).cast("binary")).alias("market_md5"))


#: Model names made of a part's name and size, one form for each of nine remainders of its key.
NAMES = ["{n} VII", "{n} gti {s}", "T-{n} (phase {s})", "{n} 1.{s}", "e-{s} {n}", "Ç-{n}–Hr É", "xl {n} st (b) (c)", "{s} {n} ", "{n}-{n}"]


def _name_sql() -> str:
    cases = []
    for i, form in enumerate(NAMES):
        pieces = form.replace("{n}", "\x00n\x00").replace("{s}", "\x00s\x00").split("\x00")
        cases.append(f"WHEN {i} THEN " + " || ".join({"n": "p_name", "s": "CAST(p_size AS VARCHAR)"}.get(x, f"'{x}'") for x in pieces if x))
    return "CASE p_partkey % 9 " + " ".join(cases) + " END"


def _name():
    out = None
    for i, form in enumerate(NAMES):
        pieces = form.replace("{n}", "\x00n\x00").replace("{s}", "\x00s\x00").split("\x00")
        value = F.concat(*[{"n": F.col("p_name"), "s": F.col("p_size").cast("string")}.get(x, F.lit(x)) for x in pieces if x])
        out = F.when(F.col("p_partkey") % 9 == i, value) if out is None else out.when(F.col("p_partkey") % 9 == i, value)
    return out


CANONICAL = "trim(regexp_replace(strip_accents(replace(lower(translate({0}, '‐‑‒–—―’‘´`', '------''''''''')), 'ß', 'ss')), '\\s+', ' ', 'g'))"
WORD = "CASE WHEN regexp_full_match(w, '[a-z]*[0-9]+[a-z0-9.-]*') OR regexp_full_match(w, '[ivxlcdm]+') OR w IN ('gti', 'gtd', 'gt', 'rs', 'st', 'ev', 'hev', 'phev', 'suv') OR (contains(w, '.') AND regexp_matches(w, '(^|\\.)[0-9]+(\\.|$)')) THEN upper(w) ELSE upper(w[1:1]) || w[2:] END"


def title_sql(value: str) -> str:
    """The title of a canonical text: its words, those with dashes part by part."""
    return f"array_to_string(list_transform(list_filter(string_split({value}, ' '), lambda w: w <> ''), lambda w: CASE WHEN contains(w, '-') AND NOT regexp_full_match(w, '[a-z]*[0-9]+[a-z0-9.-]*') THEN array_to_string(list_transform(list_filter(string_split(w, '-'), lambda w: w <> ''), lambda w: {WORD}), '-') ELSE {WORD} END), ' ')"


@query(f"""WITH n AS (SELECT p_partkey, p_name AS generation, {_name_sql()} AS name FROM part), c AS (SELECT *, {CANONICAL.format("name")} AS canonical, trim(regexp_replace(name, '\\([^)]+\\)', '', 'g')) AS bare FROM n),
v AS (SELECT *, CASE WHEN starts_with({CANONICAL.format("bare")}, {CANONICAL.format("generation")}) THEN trim(substr(bare, length(generation) + 1), ' -') ELSE bare END AS rest FROM c), r AS (SELECT *, {CANONICAL.format("rest")} AS added FROM v)
SELECT p_partkey, {title_sql("canonical")} AS title, nullif(upper({CANONICAL.format("regexp_extract(name, '\\(([^)]+)\\)', 1)")}), '') AS label, CASE WHEN added <> '' AND regexp_replace(added, '[^a-z0-9]', '', 'g') <> regexp_replace(lower(generation), '[^a-z0-9]', '', 'g') THEN {title_sql("added")} END AS variant FROM r""")
def str_titles(spark, sf_dir):  # STR13 STR14
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("generation"), _name().alias("name"))
    return p.select("p_partkey", titles.smart_title(F.col("name")).alias("title"), titles.generation_label(F.col("name")).alias("label"), titles.body_variant(F.col("generation"), F.col("name")).alias("variant"))


@query("""WITH n AS (SELECT c_custkey, p_brand, CASE c_custkey % 6 WHEN 0 THEN upper(p_brand) || ' ' || p_name || ' Premium 2015' WHEN 1 THEN p_brand || ', neuf (1998) ' || p_name WHEN 2 THEN '2010 - ' || p_name || ' gt-line' WHEN 3 THEN p_brand || ' 12 TBE garantie' WHEN 4 THEN '' ELSE p_type || ' /' || p_name || '/ ' || p_brand END AS title FROM customer JOIN part ON p_partkey = c_custkey),
r AS (SELECT *, CASE WHEN starts_with(lower(title), lower(p_brand)) THEN substr(title, length(p_brand) + 1) ELSE title END AS rest FROM n),
w AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(rest, '\\b(19|20)[0-9]{2}\\b', '', 'g'), '\\s+'), lambda x: trim(x, ' ,-./()')), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND lower(x) NOT IN ('""" + "', '".join(titles.NOISE) + """')) AS words FROM r)
SELECT c_custkey, CASE WHEN title <> '' THEN words[1] END AS model FROM w""")
def str_model_from_title(spark, sf_dir):  # STR15
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "part"), F.col("c_custkey") == F.col("p_partkey"))
    brand, name, k = F.col("p_brand"), F.col("p_name"), F.col("c_custkey") % 6
    title = (
        F.when(k == 0, F.concat(F.upper(brand), F.lit(" "), name, F.lit(" Premium 2015"))).when(k == 1, F.concat(brand, F.lit(", neuf (1998) "), name)).when(k == 2, F.concat(F.lit("2010 - "), name, F.lit(" gt-line")))
        .when(k == 3, F.concat(brand, F.lit(" 12 TBE garantie"))).when(k == 4, "").otherwise(F.concat(F.col("p_type"), F.lit(" /"), name, F.lit("/ "), brand))
    )
    return rows.select("c_custkey", titles.model_from_title(title, brand).alias("model"))


@query("""WITH n AS (SELECT p_partkey, ['Volkswagen', 'MERCEDES', 'audi ', 'Land Rover', 'Divers', 'N/A', p_brand][p_partkey % 7 + 1] AS make, ['Autres', 'Multivan', 'bénz', 'Allroad', 'Range', 'Modèle', 'Audi', p_name][p_partkey % 8 + 1] AS model FROM part),
b AS (SELECT *, strip_accents(lower(trim(make))) AS a, strip_accents(lower(trim(model))) AS m FROM n)
SELECT p_partkey, m IN ('autres', 'autre', 'other', 'divers', 'modele', 'marque') OR (a || '|' || m) IN ('volkswagen|multivan', 'volkswagen|caravelle', 'volkswagen|combi', 'volkswagen|vw', 'volkswagen|volkswagen', 'mercedes|benz', 'mercedes|mercedes', 'mercedes|mercddes', 'mercedes|mersedes', 'mercedes|mercedes-benz', 'audi|allroad', 'land rover|range') AS generic_model,
       a IN ('marque', 'autres', 'autre', 'other', 'divers', 'unknown', 'n/a', 'na') AS generic_make FROM b""")
def str_generic_names(spark, sf_dir):  # STR12
    pick = lambda names, last: F.element_at(F.array(*map(F.lit, names), F.col(last)), (F.col("p_partkey") % (len(names) + 1) + 1).cast("int"))
    make, model = pick(["Volkswagen", "MERCEDES", "audi ", "Land Rover", "Divers", "N/A"], "p_brand"), pick(["Autres", "Multivan", "bénz", "Allroad", "Range", "Modèle", "Audi"], "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", titles.is_generic_model(model, make).alias("generic_model"), titles.is_generic_make(make).alias("generic_make"))
