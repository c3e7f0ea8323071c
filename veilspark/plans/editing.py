"""Queries on edits, reports, lists and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.contract import ACTIONS, STAGES
from ..operators import edits, generate, labels, lists, mask, report
from .base import query, spread, table

_MASKS = ", ".join(f"'{t}'" for t, action in ACTIONS.items() if action == "mask")
_WORDS = "SELECT mask_id, text, dictionary FROM mask_results WHERE dictionary IS NOT NULL AND text IS NOT NULL AND cardinality(dictionary) > 0"


def _masks(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "mask_results").select("mask_id", "text", "dictionary")
    return spread(own).where("dictionary is not null and text is not null and size(dictionary) > 0")


_FIRST = "list_sort(map_keys(dictionary))[1]"


@query(f"""SELECT mask_id, CASE WHEN dictionary[k] IS NULL THEN text ELSE replace(text, k, dictionary[k]) END AS text, CAST(cardinality(dictionary) AS BIGINT) - CASE WHEN dictionary[k] IS NULL THEN 0 ELSE 1 END AS entries FROM (SELECT *, {_FIRST} AS k FROM ({_WORDS}))""")
def unmasked_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first placeholder of each dictionary taken back by hand."""
    out = _masks(spark, d).select("mask_id", edits.unmasked(F.col("text"), F.col("dictionary"), F.array_min(F.map_keys("dictionary"))).alias("e"))
    return out.select("mask_id", "e.text", F.size("e.dictionary").cast("bigint").alias("entries"))


@query(f"""WITH o AS (SELECT *, {_FIRST} AS k, CAST(list_min(list_filter(range(1, 1000), lambda n: NOT list_contains(map_keys(dictionary), '[CITY_' || CAST(n AS VARCHAR) || ']'))) AS VARCHAR) AS n FROM ({_WORDS}))
    SELECT mask_id, CASE WHEN dictionary[k] IS NULL THEN text ELSE replace(text, k, '[CITY_' || n || ']') END AS text, '[CITY_' || n || ']' AS placeholder FROM o""")
def retagged_texts(spark: SparkSession, d: str) -> DataFrame:
    own = _masks(spark, d).withColumn("next", edits.next_placeholder(F.col("dictionary"), F.lit("CITY")))
    out = own.select("mask_id", "next", edits.retagged(F.col("text"), F.col("dictionary"), F.array_min(F.map_keys("dictionary")), F.lit("CITY")).alias("e"))
    return out.select("mask_id", "e.text", F.col("next").alias("placeholder"))


@query("""SELECT c_custkey, 'Kunde [ORG_2] und Kunden, [ORG_1]; [ORG_2].' AS text, 'Firma' || CAST(c_custkey AS VARCHAR) AS value FROM customer""")
def values_masked_by_hand(spark: SparkSession, d: str) -> DataFrame:
    """A value that was overlooked is masked wherever it stands as a whole word, under the next free number."""
    name = F.concat(F.lit("Firma"), F.col("c_custkey").cast("string"))
    words = F.create_map(F.lit("[ORG_1]"), F.lit("Andere"))
    own = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Kunde "), name, F.lit(" und Kunden, [ORG_1]; "), name, F.lit(".")).alias("t"), words.alias("w"), name.alias("v"))
    out = own.select("c_custkey", edits.masked_value(F.col("t"), F.col("w"), F.col("v"), F.lit("ORG")).alias("e"))
    return out.select("c_custkey", "e.text", F.element_at("e.dictionary", F.lit("[ORG_2]")).alias("value"))


@query("""SELECT c_custkey, 'An [FULLNAME_1] und [CITY_2], C:\\_x, NOPE_3] bleibt.' AS text, '[CITY_2]' AS mended, '\\[X\\_9]' AS rest FROM customer""")
def repaired_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Escapes undone, a lost bracket added where the dictionary confirms it; unknown leftovers are only reported."""
    own = table(spark, d, "customer").select("c_custkey", F.lit("An \\[FULLNAME\\_1\\] und CITY\\_2], C:\\_x, NOPE_3] bleibt.").alias("t"), F.create_map(F.lit("[FULLNAME_1]"), F.lit("Anna"), F.lit("[CITY_2]"), F.lit("Bern")).alias("w"))
    out = own.select("c_custkey", edits.repaired(F.col("t"), F.col("w")).alias("e"), edits.leftovers(F.lit("[A_1] \\[X\\_9]")).alias("rest"))
    return out.select("c_custkey", "e.text", F.array_join("e.mended", ",").alias("mended"), F.array_join("rest", ",").alias("rest"))


@query("""SELECT c_custkey, 'Herr Muster' || CAST(c_custkey AS VARCHAR) || '-Neu und Muster' || CAST(c_custkey AS VARCHAR) || '-Neu, Bern' AS text, CAST(5 AS INT) AS a, CAST(19 + length(CAST(c_custkey AS VARCHAR)) AS INT) AS b, CAST(32 + 2 * length(CAST(c_custkey AS VARCHAR)) AS INT) AS c, CAST(36 + 2 * length(CAST(c_custkey AS VARCHAR)) AS INT) AS e FROM customer""")
def gold_with_new_values(spark: SparkSession, d: str) -> DataFrame:
    """A value in gold replaced by a longer one: the span around it grows, the one behind it moves."""
    key = F.col("c_custkey").cast("string")
    own = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Herr Muster"), key, F.lit(" und Muster"), key, F.lit(", Bern")).alias("t"), F.length(key).alias("n"))
    span = lambda tag, a, b: F.struct(F.lit(tag).alias("tag"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    rows = own.withColumn("s", F.array(span("FULLNAME", F.lit(5), F.col("n") + 15), span("CITY", F.length("t") - 4, F.length("t"))))
    got = rows.select("c_custkey", edits.replace_in_gold(F.col("t"), F.col("s"), [(" und", "-Neu und"), (", ", "-Neu, ")]).alias("g"))
    return got.select("c_custkey", "g.text", F.col("g.spans")[0]["start"].alias("a"), F.col("g.spans")[0]["end"].alias("b"), F.col("g.spans")[1]["start"].alias("c"), F.col("g.spans")[1]["end"].alias("e"))


@query(f"""SELECT mask_id, CAST(length(t) AS INT) AS chars, CAST(coalesce(list_sum(list_transform(list_filter(spans, lambda s: s.tag IN ({_MASKS})), lambda s: s.end_pos - s.start_pos)), 0) AS INT) AS masked_chars,
    round(coalesce(list_sum(list_transform(list_filter(spans, lambda s: s.tag IN ({_MASKS})), lambda s: s.end_pos - s.start_pos)), 0) / greatest(1, length(t)), 3) AS share, CAST(len(spans) AS INT) AS spans, CAST(coalesce(cardinality(dictionary), 0) AS INT) AS entries
    FROM (SELECT mask_id, spans, dictionary, coalesce(d.text, '') AS t FROM mask_results JOIN documents d USING (doc_id) WHERE spans IS NOT NULL)""")
def text_figures(spark: SparkSession, d: str) -> DataFrame:
    own = F.transform("spans", lambda s: F.struct(s["tag"].alias("tag"), s["start_pos"].alias("start"), s["end_pos"].alias("end")))
    rows = table(spark, d, "mask_results").where("spans is not null").select("mask_id", "doc_id", own.alias("s"), "dictionary").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("mask_id", report.figures(F.coalesce("text", F.lit("")), F.col("s"), F.col("dictionary")).alias("f")).select("mask_id", "f.*")


@query("SELECT s.tag AS tag, s.quelle AS quelle, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(spans) AS s FROM mask_results) GROUP BY 1, 2")
def span_sources(spark: SparkSession, d: str) -> DataFrame:
    return report.histogram(table(spark, d, "mask_results").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.tag", "s.quelle"), "tag", "quelle")


@query(f"SELECT tag FROM (VALUES {', '.join(f'({t!r})' for t in STAGES)}) t(tag) WHERE tag NOT IN (SELECT DISTINCT s.tag FROM (SELECT unnest(spans) AS s FROM examples) WHERE s.tag IS NOT NULL)")
def tags_never_seen(spark: SparkSession, d: str) -> DataFrame:
    return report.never_seen(table(spark, d, "examples").select(F.explode("spans.tag").alias("tag")))


@query("SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY 2, 1 LIMIT 50")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents in hash order: the limit is what the operator does."""
    return report.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50).select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))


@query(f"""WITH e AS (SELECT mask_id, unnest(map_entries(dictionary)) AS e FROM ({_WORDS})), v AS (SELECT DISTINCT mask_id, regexp_extract(e.key, '^\\[(.*)_[^_]*$', 1) AS tag, e.value AS value FROM e WHERE e.value IS NOT NULL)
    SELECT v.mask_id, v.tag, v.value, true AS there FROM v""")
def placeholders_of_values(spark: SparkSession, d: str) -> DataFrame:
    """Back from tag and value to a placeholder that stands for it."""
    rows = _masks(spark, d).select("mask_id", "dictionary", F.explode("dictionary").alias("key", "value")).where("value is not null").select("mask_id", "dictionary", F.regexp_extract("key", r"^\[(.*)_[^_]*$", 1).alias("tag"), "value")
    got = rows.select("mask_id", "tag", "value", F.element_at("dictionary", edits.placeholder_of(F.col("dictionary"), F.col("tag"), F.col("value"))).alias("back"))
    return got.select("mask_id", "tag", "value", F.col("back").eqNullSafe(F.col("value")).alias("there")).distinct()


@query("""WITH p AS (SELECT street_name AS name, coalesce(plz, '') AS plz, coalesce(city, '') AS city, coalesce(municipality, '') AS municipality FROM streets WHERE street_name IS NOT NULL AND plz IS NOT NULL AND city IS NOT NULL)
    SELECT name, plz, city, municipality FROM p UNION ALL SELECT name, '9999', 'Zweitort', municipality FROM p""")
def street_places(spark: SparkSession, d: str) -> DataFrame:
    """A row for each postcode and place of a street that runs through two of them."""
    own = table(spark, d, "streets").where("street_name is not null and plz is not null and city is not null")
    labelled = own.withColumn("zip_label", F.concat("plz", F.lit(" "), "city", F.lit(", 9999 Zweitort")))
    return lists.addresses(labelled).select("name", "plz", "city", F.col("municipality"))


@query("SELECT name, row_number() OVER (ORDER BY lower(strip_accents(name)), name) AS place FROM (SELECT DISTINCT trim(regexp_replace(name_form, '\\s+', ' ', 'g')) AS name FROM name_weights WHERE name_form IS NOT NULL) WHERE name <> ''")
def built_list(spark: SparkSession, d: str) -> DataFrame:
    """A list in normal form and order, as it is written."""
    rows = lists.built(table(spark, d, "name_weights").select(F.col("name_form").alias("name")).where("name is not null"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(text.plain_key(F.col("name")), "name")).cast("bigint"))


@query("SELECT name, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT trim(name_form) AS name, coalesce(weight, 0) AS w FROM name_weights WHERE name_form IS NOT NULL) GROUP BY 1")
def summed_names(spark: SparkSession, d: str) -> DataFrame:
    """Weights with thousands marks, as registers write them."""
    marked = table(spark, d, "name_weights").withColumn("weight", F.replace(F.format_number(F.col("weight"), 0), F.lit(","), F.lit("'")))
    return lists.weighted_names(marked, "name_form", "weight")


_DIGITS = ", ".join(f"sum(('0x' || substr(h, {1 + 12 * k}, 12))::BIGINT)" for k in range(5))


@query(f"""WITH v AS (SELECT DISTINCT CAST(to_json(struct_pack(kind := kind, name := trim(regexp_replace(name_form, '\\s+', ' ', 'g')))) AS VARCHAR) AS v FROM name_weights WHERE name_form IS NOT NULL AND kind IS NOT NULL), h AS (SELECT sha256(v) AS h FROM v)
    SELECT count(*) AS n, substr(sha256(concat_ws('|', count(*), {_DIGITS})), 1, 16) AS fingerprint FROM h""")
def list_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return lists.fingerprint(table(spark, d, "name_weights").where("kind is not null").select(F.col("name_form").alias("name"), "kind"))


@query("""WITH r AS (SELECT kind, name_form, CAST(sum(w) OVER (PARTITION BY kind ORDER BY name_form) AS BIGINT) AS upto FROM (SELECT kind, name_form, sum(greatest(1, CAST(floor(sqrt(greatest(coalesce(weight, 0), 0))) AS INT))) AS w FROM name_weights WHERE name_form IS NOT NULL AND kind IS NOT NULL GROUP BY 1, 2)),
    t AS (SELECT max(upto) AS total FROM r WHERE kind = 'family')
    SELECT c_custkey, (SELECT arg_min(name_form, upto) FROM r WHERE kind = 'family' AND upto > ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % total) AS name FROM customer, t""")
def weighted_draws(spark: SparkSession, d: str) -> DataFrame:
    """A family name for every customer, drawn by dampened weight from a hash of the key."""
    ranges = generate.weighted(table(spark, d, "name_weights").where("kind is not null"), "kind", "name_form", "weight")
    rows = table(spark, d, "customer").select("c_custkey", F.lit("family").alias("kind"))
    return generate.draw_weighted(rows, F.col("c_custkey"), ranges, "kind", "name_form", "name").select("c_custkey", "name")


_MONTH = lambda lang: "[" + ", ".join(f"'{m}'" for m in text.MONTHS[lang]) + "]"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN CAST(day(o_orderdate) AS VARCHAR) || CASE WHEN l = 'de' THEN '. ' ELSE ' ' END || CASE l WHEN 'de' THEN {_MONTH('de')}[month(o_orderdate)] WHEN 'fr' THEN {_MONTH('fr')}[month(o_orderdate)] WHEN 'it' THEN {_MONTH('it')}[month(o_orderdate)] ELSE {_MONTH('en')}[month(o_orderdate)] END || ' ' || CAST(year(o_orderdate) AS VARCHAR)
    ELSE CASE WHEN l = 'en' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END END AS shown FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, ['de', 'fr', 'it', 'en'][o_orderkey // 3 % 4 + 1] AS l FROM orders)""")
def dates_shown(spark: SparkSession, d: str) -> DataFrame:
    """Dates in three spellings and four languages."""
    lang = F.element_at(F.array(*[F.lit(x) for x in ("de", "fr", "it", "en")]), (F.pmod(F.floor(F.col("o_orderkey") / 3), F.lit(4)) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", text.date_shown(F.col("o_orderdate").cast("date"), lang, F.pmod(F.col("o_orderkey"), F.lit(3))).alias("shown"))


@query("SELECT o_custkey, o_orderkey, strftime(DATE '2020-01-01' + CAST(sum(1 + o_orderkey % 399) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS INT), '%Y-%m-%d') AS cursor_day FROM orders")
def running_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates that move forward by 1 to 399 days from row to row."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    days = F.sum(1 + F.pmod(F.col("o_orderkey"), F.lit(399))).over(w).cast("int")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_add(F.lit("2020-01-01").cast("date"), days).cast("string").alias("cursor_day"))


@query("""WITH t AS (SELECT doc_id, unnest([0, 10, 20, 30]) AS a, ((doc_id * 7) % 10) / 10.0 AS p FROM documents), s AS (SELECT doc_id, 'FULLNAME' AS tag, 5 AS start_pos, 15 AS end_pos FROM documents UNION ALL SELECT doc_id, 'CITY', 40, 45 FROM documents)
    SELECT s.doc_id, s.tag, CAST(s.start_pos AS INT) AS start_pos, CAST(s.end_pos AS INT) AS end_pos, CAST(coalesce(min(t.p + t.a / 1000.0), 0) AS DOUBLE) AS score FROM s LEFT JOIN t ON t.doc_id = s.doc_id AND t.a < s.end_pos AND s.start_pos < t.a + 8 GROUP BY 1, 2, 3, 4""")
def token_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of a span is the least of the tokens that overlap it."""
    docs = table(spark, d, "documents").select("doc_id")
    toks = docs.select("doc_id", F.explode(F.array(*[F.lit(x) for x in (0, 10, 20, 30)])).alias("start_pos")).withColumn("end_pos", F.col("start_pos") + 8).withColumn("p", F.pmod(F.col("doc_id") * 7, F.lit(10)) / 10.0 + F.col("start_pos") / 1000.0)
    own = docs.select("doc_id", F.lit("FULLNAME").alias("tag"), F.lit(5).alias("start_pos"), F.lit(15).alias("end_pos")).unionByName(docs.select("doc_id", F.lit("CITY").alias("tag"), F.lit(40).alias("start_pos"), F.lit(45).alias("end_pos")))
    return labels.span_scores(own, toks)


@query("""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents) GROUP BY 1""")
def used_tokens(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scoring import used_tokens as used

    return used(spread(table(spark, d, "documents").select("text")), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))


@query("""WITH u AS (SELECT mask_id, unnest(regexp_extract_all(replace(text, '_1]', '_99]'), '\\[[A-Za-z][A-Za-z0-9_]*_[0-9]+[a-z]*\\]')) AS ph, dictionary FROM mask_results WHERE dictionary IS NOT NULL)
    SELECT mask_id, count(DISTINCT ph) AS unknown FROM u WHERE dictionary[ph] IS NULL GROUP BY 1""")
def unknown_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders of an edited text that the dictionary doesn't know."""
    rows = spread(table(spark, d, "mask_results").select("mask_id", "text", "dictionary")).where("dictionary is not null")
    report_ = rows.select("mask_id", mask.restore_report(F.replace("text", F.lit("_1]"), F.lit("_99]")), F.col("dictionary")).alias("r"))
    return report_.select("mask_id", F.size("r.missing").cast("bigint").alias("unknown")).where("unknown > 0")
