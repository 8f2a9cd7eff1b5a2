"""Document extraction: orders become nested strain and medium documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cultiva.functions import documents as D
from cultiva.functions import scalars as S
from cultiva.operators import documents as O
from cultiva.sources.documents import parse_documents
from suite.base import query, r, rounded, spread, table, with_sql

# One JSON text per order. Shapes (absent, object, list), markers and numbers
# follow from the order key; every 50th document is broken.
STRAIN_JSON = r"""
concat('{"General":{"BacDive-ID":', k,
  CASE k % 4 WHEN 0 THEN concat(',"NCBI tax id":{"NCBI tax id":', k % 1000, ',"Matching level":"species"}')
             WHEN 1 THEN concat(',"NCBI tax id":["x",{"NCBI tax id":"abc"},{"NCBI tax id":"', k % 999, '"}]')
             WHEN 2 THEN ',"NCBI tax id":null' ELSE '' END, '}',
  ',"Name and taxonomic classification":{"species":"Sp ', k % 13, '"', ',"genus":"G', k % 7, '"',
  CASE k % 3 WHEN 0 THEN concat(',"LPSN":{"family":"L', k % 10, '"},"family":"F"')
             WHEN 1 THEN concat(',"LPSN":{"family":""},"family":"F', k % 7, '"') ELSE '' END, '}',
  ',"Culture and growth conditions":{"culture temp":',
  CASE k % 6 WHEN 0 THEN concat('{"type":"growth","growth":"positive","temperature":"', a, '"}')
             WHEN 1 THEN concat('[{"type":"growth","growth":"positive","temperature":"', a, '"},{"type":"Optimum","growth":"no","temperature":"', b,
                                '"},{"type":"optimum","temperature":"', c, '-', d, '"},{"type":"optimum","temperature":"1d"}]')
             WHEN 2 THEN concat('[{"type":"growth","growth":"positive","temperature":"5-30"},{"type":"Growth","growth":"YES","temperature":" ', a,
                                ' C"},{"type":"growth","growth":"+","temperature":', b, '},{"type":"growth","growth":"no","temperature":"99"}]')
             WHEN 3 THEN concat('[{"type":"growth","growth":"true","temperature":', a, '},7,null,{"type":"growth","growth":"positive","temperature":"', b, '"}]')
             WHEN 4 THEN 'null' ELSE '"junk"' END,
  CASE k % 5 WHEN 0 THEN concat(',"culture pH":[{"type":"optimum","pH":"', (k % 80) / 10, '"}]')
             WHEN 1 THEN concat(',"culture pH":{"type":"growth","growth":"positive","pH":"6.0-', 7 + k % 3, '.5"}') ELSE '' END,
  CASE k % 3 WHEN 0 THEN concat(',"culture medium":[{"name":"M', k % 30, '","growth":" Yes ","link":"https://media.example/medium/1', k % 30,
                                'a"},{"link":null},{"name":"none","link":"https://media.example/x"},{"name":"J","link":"/medium/J22?x=1"}]')
             WHEN 1 THEN concat(',"culture medium":{"name":"S","growth":"no","link":"https://media.example/medium/', k % 17, '"}') ELSE '' END, '}',
  ',"Physiology and metabolism":{"oxygen tolerance":',
  CASE k % 4 WHEN 0 THEN '[{"oxygen tolerance":""},{"oxygen tolerance":"aerobe"}]' WHEN 1 THEN '{"oxygen tolerance":"anaerobe"}'
             WHEN 2 THEN 'null' ELSE '[{"x":1}]' END,
  CASE k % 6 WHEN 0 THEN concat(',"halophily":[{"salt":"NaCl","growth":"positive","tested relation":"optimum","concentration":"3 %"},{"salt":"NaCl","growth":"positive","tested relation":"growth","concentration":"', a, ' %"}]')
             WHEN 1 THEN ',"halophily":[{"salt":"KCl","growth":"positive","tested relation":"growth","concentration":"9"},{"growth":"positive","tested relation":"growth","concentration":"2-3 %"}]'
             WHEN 2 THEN concat(',"halophily":[{"growth":"positive","tested relation":"inconsistent","salt concentration":"', a, '"},{"growth":"no","tested relation":"growth","concentration":"40"}]')
             WHEN 3 THEN concat(',"halophily":{"salt":"","growth":"yes","tested relation":"optimum growth","concentration":"', b, ' %"}')
             WHEN 4 THEN ',"halophily":[]' ELSE '' END, '}',
  ',"Sequence information":{"Genome sequences":',
  CASE k % 5 WHEN 0 THEN concat('[{"assembly level":"x"},{"NCBI accession":"N', k, '"}]') WHEN 1 THEN concat('{"INSDC accession":"","accession":"A', k, '"}')
             WHEN 2 THEN concat('[{"accession":"A1","INSDC accession":"I', k, '"}]') ELSE 'null' END, '}',
  ',"Isolation, sampling and environmental information":{"isolation source categories":',
  CASE k % 3 WHEN 0 THEN '[{"Cat1":"#Host","Cat2":"#Human"},{"Cat1":"#Env","Cat2":""},{"Cat1":"##Host","Cat3":"# Blood "},5]'
             WHEN 1 THEN concat('{"Cat1":"#E', k % 4, '","Cat2":7}') ELSE 'null' END,
  CASE k % 4 WHEN 0 THEN concat(',"isolation":[{"sample type":"soil near plant","country":"C', k % 5, '","continent":"Asia","latitude":"12.5","longitude":-3.25,"sampling date":"2011-05-0', k % 9 + 1,
                                '","host species":"Homo sapiens"},{"country":"other"}]')
             WHEN 1 THEN concat(',"isolation":{"sample type":"sheep rumen","isolation date":"in ', 1950 + k % 50, ', or 2003","sampling date":"unknown","country":5,"latitude":"n/a","geographic location":"hill"}')
             WHEN 2 THEN ',"isolation":{"host species":"Oryza (rice)","sample type":"human","continent":"Europe"}' ELSE '' END, '}}',
  CASE WHEN k % 50 = 13 THEN '{' ELSE '' END)
"""
NUMBERS = ["k % 40 AS a", "k % 37 + 1 AS b", "k % 23 AS c", "k % 23 + k % 9 + 1 AS d"]
KEYS_SQL = """
keys AS (SELECT o_orderkey AS k, o_orderkey % 40 AS a, o_orderkey % 37 + 1 AS b, o_orderkey % 23 AS c,
                o_orderkey % 23 + o_orderkey % 9 + 1 AS d
         FROM orders WHERE o_orderkey % 50 <> 13)
"""


def strain_docs(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    keys = spread(orders, "k").selectExpr("k", *NUMBERS)
    texts = keys.select(F.col("k").alias("bacdive_id"), F.expr(STRAIN_JSON).alias("value"))
    return parse_documents(texts)


TEMPERATURE = """CASE k % 6 WHEN 0 THEN a WHEN 1 THEN (b + (c + d) / 2.0) / 2
  WHEN 2 THEN list_sort([17.5, a, b])[2] WHEN 3 THEN (a + b) / 2.0 END"""
PH = "CASE k % 5 WHEN 0 THEN (k % 80) / 10.0 WHEN 1 THEN (6.0 + 7 + k % 3 + 0.5) / 2 END"
SALT = "CASE k % 6 WHEN 0 THEN 3 WHEN 2 THEN a WHEN 3 THEN b END"


@query(
    "extract_phenotypes",
    with_sql(KEYS_SQL)
    + f"""SELECT k AS bacdive_id, 'Sp ' || (k % 13) AS species, 'G' || (k % 7) AS genus,
  CASE k % 3 WHEN 0 THEN 'L' || (k % 10) WHEN 1 THEN 'F' || (k % 7) END AS family,
  CASE k % 4 WHEN 0 THEN k % 1000 WHEN 1 THEN k % 999 END AS ncbi_taxon_id,
  {r(TEMPERATURE)} AS optimal_temperature_c, {r(PH)} AS optimal_ph,
  CASE k % 4 WHEN 0 THEN 'aerobe' WHEN 1 THEN 'anaerobe' END AS oxygen_requirement,
  {r(SALT)} AS salt_tolerance_pct,
  CASE k % 5 WHEN 0 THEN 'N' || k WHEN 1 THEN 'A' || k WHEN 2 THEN 'I' || k END AS genome_accession,
  CASE k % 3 WHEN 0 THEN 'Env|Host' WHEN 1 THEN 'E' || (k % 4) END AS isolation_cat1,
  CASE k % 3 WHEN 0 THEN 'Human' END AS isolation_cat2, CASE k % 3 WHEN 0 THEN 'Blood' END AS isolation_cat3
FROM keys""",
)
def extract_phenotypes(spark, folder):
    return rounded(O.extract_phenotypes(strain_docs(spark, folder)))


@query(
    "strain_media_links",
    with_sql(KEYS_SQL)
    + """SELECT k AS bacdive_id, '1' || (k % 30) || 'a' AS medium_id, 'M' || (k % 30) AS medium_name, 'yes' AS growth FROM keys WHERE k % 3 = 0
UNION ALL SELECT k, 'J22', 'J', '' FROM keys WHERE k % 3 = 0
UNION ALL SELECT k, (k % 17)::varchar, 'S', 'no' FROM keys WHERE k % 3 = 1""",
)
def strain_media_links(spark, folder):
    return O.strain_media_links(strain_docs(spark, folder))


@query(
    "parse_isolation",
    with_sql(KEYS_SQL)
    + """SELECT k AS bacdive_id, CASE k % 4 WHEN 0 THEN 'C' || (k % 5) END AS iso_country,
  CASE k % 4 WHEN 0 THEN 'Asia' WHEN 2 THEN 'Europe' END AS iso_continent,
  CASE k % 4 WHEN 0 THEN 12.5::double END AS iso_lat, CASE k % 4 WHEN 0 THEN (-3.25)::double END AS iso_lon,
  CASE k % 4 WHEN 0 THEN 2011 WHEN 1 THEN (1950 + k % 50)::int END AS iso_collection_year,
  CASE k % 4 WHEN 0 THEN 'Homo sapiens' WHEN 2 THEN 'Oryza (rice)' END AS iso_host_species,
  CASE k % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'other' WHEN 2 THEN 'plant' END AS iso_host_kingdom,
  CASE k % 4 WHEN 0 THEN 'soil near plant' WHEN 1 THEN 'sheep rumen' WHEN 2 THEN 'human' END AS iso_sample_text,
  CASE k % 4 WHEN 1 THEN 'hill' END AS iso_geographic_location FROM keys""",
)
def parse_isolation(spark, folder):
    return O.parse_isolation(strain_docs(spark, folder))


@query(
    "list_coercion",
    with_sql(KEYS_SQL)
    + """SELECT k AS bacdive_id, CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 0 ELSE 1 END AS n_temp,
  CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 0 END AS n_media FROM keys""",
)
def list_coercion(spark, folder):
    d = F.col("doc")
    return strain_docs(spark, folder).select(
        "bacdive_id",
        F.size(D.list_at(d, O.CULTURE, "culture temp")).alias("n_temp"),
        F.size(D.list_at(d, O.CULTURE, "culture medium")).alias("n_media"),
    )


# One medium document per order: solutions and compounds follow from the key.
MEDIUM_JSON = r"""
concat('{"medium":{"id":', CASE WHEN k % 2 = 0 THEN cast(k as string) ELSE concat('"J', k, '"') END, ',"name":"Medium ', k % 50, '","complex_medium":', k % 2,
  CASE WHEN k % 3 = 0 THEN '' ELSE concat(',"min_pH":', (k % 60) / 10) END, ',"max_pH":"', (k % 80) / 10, '","source":"DB","link":null},"solutions":',
  CASE k % 4 WHEN 0 THEN concat('[{"name":"main","recipe":[{"compound":"NaCl","compound_id":', k % 9, ',"amount":', a, ',"unit":"g","g_l":', a / 2,
                                ',"optional":1},{"compound":"","amount":3},{"compound":"Agar","amount":null},"x"]},{"recipe":[{"compound":"Water","amount":1000,"unit":"ml","condition":"hot"}]}]')
             WHEN 1 THEN '[{"name":"main","recipe":[{"compound":"Peptone","optional":null,"g_l":"2.5"}]}]'
             WHEN 2 THEN '[]' ELSE 'null' END, '}')
"""
ALL_KEYS_SQL = "keys AS (SELECT o_orderkey AS k, o_orderkey % 40 AS a FROM orders)"
MEDIUM_ID = "CASE WHEN k % 2 = 0 THEN k::varchar ELSE 'J' || k END"


def medium_docs(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    keys = spread(orders, "k").selectExpr("k", NUMBERS[0])
    return parse_documents(keys.select(F.expr(MEDIUM_JSON).alias("value")))


@query(
    "normalize_recipes",
    with_sql(ALL_KEYS_SQL)
    + f"""SELECT {MEDIUM_ID} AS medium_id, s AS solution_name, i AS compound_id, c AS compound, m AS amount, u AS unit, g AS g_l, o AS optional, n AS condition
FROM (
SELECT k, 'main' AS s, k % 9 AS i, 'NaCl' AS c, a::double AS m, 'g' AS u, a / 2.0 AS g, 1 AS o, NULL::varchar AS n FROM keys WHERE k % 4 = 0
UNION ALL SELECT k, 'main', NULL, 'Agar', NULL, NULL, NULL, 0, NULL FROM keys WHERE k % 4 = 0
UNION ALL SELECT k, '', NULL, 'Water', 1000, 'ml', NULL, 0, 'hot' FROM keys WHERE k % 4 = 0
UNION ALL SELECT k, 'main', NULL, 'Peptone', NULL, NULL, 2.5, 0, NULL FROM keys WHERE k % 4 = 1)""",
)
def normalize_recipes(spark, folder):
    return O.normalize_recipes(medium_docs(spark, folder))


@query(
    "medium_metadata",
    with_sql(ALL_KEYS_SQL)
    + f"""SELECT {MEDIUM_ID} AS medium_id, 'Medium ' || (k % 50) AS name, (k % 2)::int AS complex_medium,
  CASE WHEN k % 3 <> 0 THEN {r("(k % 60) / 10.0")} END AS "min_pH", {r("(k % 80) / 10.0")} AS "max_pH", 'DB' AS source, NULL::varchar AS link,
  CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_solutions FROM keys""",
)
def medium_metadata(spark, folder):
    return rounded(O.medium_metadata(medium_docs(spark, folder)))


# Free-text measurements made from events.
EVENT_TEXT = """CASE event_id % 10 WHEN 0 THEN concat(v, ' %') WHEN 1 THEN concat(v, '-', w) WHEN 2 THEN concat(v, '-', w, ' %')
  WHEN 3 THEN concat('-', v) WHEN 4 THEN concat('>', v) WHEN 5 THEN '' WHEN 6 THEN concat(v, ' - ', w) WHEN 7 THEN concat(v, 'd')
  WHEN 8 THEN concat(v, '-', w, '-', v) ELSE concat('  ', v, 'e1 x') END"""
EVENTS_SQL = "base AS (SELECT event_id, event_id % 97 AS v, event_id % 31 AS w FROM events)"


@query(
    "parse_measurements",
    with_sql(EVENTS_SQL)
    + f"""SELECT event_id, {r('''CASE event_id % 10 WHEN 0 THEN v WHEN 1 THEN (v + w) / 2.0 WHEN 3 THEN -v WHEN 6 THEN (v + w) / 2.0
  WHEN 8 THEN (v + w) / 2.0 WHEN 9 THEN v * 10 END''')} AS measurement FROM base""",
)
def parse_measurements(spark, folder):
    base = table(spark, folder, "events").selectExpr("event_id", "event_id % 97 AS v", "event_id % 31 AS w")
    texts = base.select("event_id", F.expr(EVENT_TEXT).alias("text"))
    return rounded(O.parse_measurement(texts, "text", "measurement").drop("text"))


@query(
    "event_props_extraction",
    "SELECT event_id, json_extract(props, '$.k')::bigint AS k FROM events",
)
def event_props_extraction(spark, folder):
    docs = parse_documents(table(spark, folder, "events").select("event_id", F.col("props").alias("value")))
    return docs.select("event_id", F.try_variant_get(F.col("doc"), D.path("k"), "bigint").alias("k"))


@query(
    "medium_id_from_link",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE regexp_extract(url, '^https?://[^/]+/[^/]+/([A-Za-z0-9]+)', 1) END AS medium_id FROM pages""",
)
def medium_id_from_link(spark, folder):
    # the language folder of the url becomes the medium folder on two of three pages
    link = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.regexp_replace("url", r"^(https?://[^/]+)/[^/]+/", "$1/medium/")
    )
    return table(spark, folder, "pages").select("page_id", S.medium_id_from_link(link).alias("medium_id"))


@query(
    "parse_year",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN year(o_orderdate)::int
  ELSE (1900 + o_orderkey % 100)::int END AS year FROM orders""",
)
def parse_year(spark, folder):
    text = F.expr(
        """CASE o_orderkey % 3 WHEN 0 THEN concat('x', year(o_orderdate)) WHEN 1 THEN concat('no. 12345, ', date_format(o_orderdate, 'yyyy-MM-dd'))
        ELSE concat('ca ', 1900 + o_orderkey % 100, ' to 2015') END"""
    )
    return table(spark, folder, "orders").select("o_orderkey", S.parse_year(text).alias("year"))


HOSTS = ["Homo sapiens", "Brat plant", "honey BEE", "Oak leaf", "bread yeast", "granite", "", "Rice field mouse"]
HOSTS_SPARK = ", ".join(f"'{h}'" for h in HOSTS)
KINGDOMS = ["human", "animal", "animal", "plant", "fungal", "other", None, "animal"]
KINGDOMS_SQL = ", ".join("NULL" if k is None else f"'{k}'" for k in KINGDOMS)


@query("host_kingdom", f"SELECT c_custkey, [{KINGDOMS_SQL}][(c_custkey % 8 + 1)::int] AS kingdom FROM customer")
def host_kingdom(spark, folder):
    host = F.expr(f"array({HOSTS_SPARK})[cast(c_custkey % 8 as int)]")
    return table(spark, folder, "customer").select("c_custkey", S.host_kingdom(host).alias("kingdom"))


@query(
    "phylum_of_lineage",
    """SELECT s.s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN '—' WHEN 2 THEN '—' ELSE n_name END AS phylum
FROM supplier s JOIN nation ON s_nationkey = n_nationkey""",
)
def phylum_of_lineage(spark, folder):
    lineage = F.expr(
        """CASE s_suppkey % 4 WHEN 0 THEN concat('d__Bacteria;p__', n_name, ';c__X') WHEN 1 THEN 'd__Bacteria;p__;p__Second'
        WHEN 2 THEN NULL ELSE concat('d__A; p__', n_name, ' ') END"""
    )
    joined = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.select("s_suppkey", S.phylum(lineage).alias("phylum"))


@query(
    "accession_forms",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'GCA_' || lpad(c_custkey::varchar, 9, '0') WHEN 1 THEN 'GCF_' || lpad(c_custkey::varchar, 9, '0')
    WHEN 2 THEN 'GCF_' || lpad(c_custkey::varchar, 9, '0') ELSE '' END AS bare,
  c_custkey % 4 < 2 AS versioned, c_custkey % 4 < 2 AS valid, CASE WHEN c_custkey % 4 < 2 THEN 1 ELSE 4 END AS n_candidates FROM customer""",
)
def accession_forms(spark, folder):
    padded = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    kind = F.col("c_custkey") % 4
    genbank = F.when(kind == 0, F.concat(F.lit("GCA_"), padded, F.lit(".12")))
    accession = (
        F.when(kind == 1, F.concat(F.lit("RS_GCF_"), padded, F.lit(".3")))
        .when(kind == 2, F.concat(F.lit("GB_GCF_"), padded))
    )
    shown = F.when(kind < 2, F.concat(F.lit("gca_"), padded, F.lit(".1"))).otherwise(F.concat(padded, F.lit(".X")))
    return table(spark, folder, "customer").select(
        "c_custkey",
        S.bare_accession(genbank, accession).alias("bare"),
        S.has_version(shown).alias("versioned"),
        S.looks_like_accession(shown).alias("valid"),
        F.size(S.candidate_accessions(shown)).alias("n_candidates"),
    )


@query(
    "slugify_tags",
    r"""SELECT DISTINCT p_name, p_type, 'a_lt_' || replace(p_name, ' ', '_') || '_gt' || lower(p_type) || '_1' AS slug FROM part""",
)
def slugify_tags(spark, folder):
    tag = F.concat(F.lit("-A <- "), "p_name", F.lit(" >"), "p_type", F.lit("/1%"))
    return table(spark, folder, "part").select("p_name", "p_type").distinct().select(
        "p_name", "p_type", S.slugify(tag).alias("slug")
    )


@query(
    "group_key_modes",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'G' || (c_custkey % 10) END,
    CASE WHEN c_custkey % 5 <> 0 THEN 'Gen' || (c_custkey % 6) END, '__unknown__') AS first_word,
  coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'G' || (c_custkey % 10) END,
    CASE WHEN c_custkey % 5 <> 0 THEN 'Gen' || (c_custkey % 6) || ' epi' END, '__unknown__') AS whole_species,
  coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, '__unknown__') AS family_only FROM customer""",
)
def group_key_modes(spark, folder):
    k = F.col("c_custkey")
    family = F.when(k % 2 == 0, F.col("c_mktsegment"))
    genus = F.when(k % 3 == 0, F.concat(F.lit("G"), (k % 10).cast("string")))
    species = F.when(k % 5 != 0, F.concat(F.lit("Gen"), (k % 6).cast("string"), F.lit(" epi")))
    return table(spark, folder, "customer").select(
        "c_custkey",
        S.group_key(family, genus, species).alias("first_word"),
        S.group_key(family, genus, species, "whole_species").alias("whole_species"),
        S.group_key(family, genus, species, "family").alias("family_only"),
    )


@query(
    "collapse_labels",
    """SELECT o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 'aerobe' WHEN 'F' THEN 'facultative' ELSE o_orderpriority END AS label, count(*) AS n
FROM orders GROUP BY ALL""",
)
def collapse_labels(spark, folder):
    status = F.col("o_orderstatus")
    label = (
        F.when(status == "O", "obligate aerobe").when(status == "F", "aerotolerant").otherwise(F.col("o_orderpriority"))
    )
    return (
        table(spark, folder, "orders")
        .select("o_orderpriority", S.map_labels(label).alias("label"))
        .groupBy("o_orderpriority", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "value_bands",
    f"""SELECT CASE WHEN v < 15 THEN '<15' WHEN v < 30 THEN '15-30' WHEN v < 45 THEN '30-45' WHEN v < 60 THEN '45-60' ELSE '>=60' END AS temperature_band,
  CASE WHEN v / 10 < 6 THEN '<6' WHEN v / 10 < 7.5 THEN '6-7.5' ELSE '>=7.5' END AS ph_band,
  CASE WHEN v / 20 < 1 THEN '<1' WHEN v / 20 < 5 THEN '1-5' ELSE '>=5' END AS salt_band, count(*) AS n, {r('avg(round_even(v / 7, 3))', 4)} AS mean_shown
FROM (SELECT value AS v FROM events) GROUP BY ALL""",
)
def value_bands(spark, folder):
    v = F.col("value")
    return rounded(
        table(spark, folder, "events")
        .select(
            S.temperature_band(v).alias("temperature_band"),
            S.ph_band(v / 10).alias("ph_band"),
            S.salt_band(v / 20).alias("salt_band"),
            S.safe_float(v / 7, 3).alias("shown"),
        )
        .groupBy("temperature_band", "ph_band", "salt_band")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("shown").alias("mean_shown")),
        4,
    )


@query(
    "truly_uncultured",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN true ELSE false END AS truly_uncultured FROM customer""",
)
def truly_uncultured(spark, folder):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Uncultured "), "c_name")).when(k % 3 == 1, F.col("c_name"))
    return table(spark, folder, "customer").select(
        "c_custkey", S.truly_uncultured(name).alias("truly_uncultured")
    )
