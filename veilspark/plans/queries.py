"""The engine's queries over the test tables, and for each that SQL can state, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, text
from ..functions.contract import ACTIONS, STAGES, THRESHOLDS, label_hash, severity, tag_table
from ..operators import evaluate, generate, labels, mask, rules, spans, suspicion, synthesis
from ..operators.recognise import RULES, recognised
from ..streaming.stream import details_per_window
from .base import ORACLES, QUERIES, matches_sql, query, rows_of, spread, table


@query(matches_sql(RULES["EMAIL"].pattern))
def email_places(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return rows_of(docs.select("doc_id", text.matches(F.col("text"), RULES["EMAIL"].pattern).alias("s")), "s", "doc_id")


@query(matches_sql(RULES["CASE_ID"].pattern))
def case_number_places(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return rows_of(docs.select("doc_id", text.matches(F.col("text"), RULES["CASE_ID"].pattern).alias("s")), "s", "doc_id")


_LINKED = "'Siehe https://www.example.ch/d/' || CAST(doc_id AS VARCHAR) || '?a=' || CAST(length(text) AS VARCHAR) || '. ' || text"


@query(matches_sql(RULES["URL"].pattern, "linked", "doc_id", f"(SELECT doc_id, {_LINKED} AS linked FROM documents)"))
def url_places(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    linked = F.concat(F.lit("Siehe https://www.example.ch/d/"), F.col("doc_id").cast("string"), F.lit("?a="), F.length("text").cast("string"), F.lit(". "), F.col("text"))
    return rows_of(docs.select("doc_id", text.matches(linked, RULES["URL"].pattern).alias("s")), "s", "doc_id")


@query(f"""SELECT doc_id, start_pos, CAST(length(substr(t, 1, start_pos)) - length(replace(substr(t, 1, start_pos), chr(10), '')) + 1 AS INT) AS line,
    replace(substr(t, greatest(start_pos - 28, 0) + 1, start_pos - greatest(start_pos - 28, 0)) || '»' || value || '«' || substr(t, end_pos + 1, 28), chr(10), '⏎') AS shown
    FROM ({matches_sql(RULES["EMAIL"].pattern)}) JOIN (SELECT doc_id, text AS t FROM documents) USING (doc_id)""")
def email_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", "text", F.explode(text.matches(F.col("text"), RULES["EMAIL"].pattern)).alias("s"))
    return found.select("doc_id", F.col("s.start").alias("start_pos"), text.line_number(F.col("text"), F.col("s.start")).alias("line"), text.snippet(F.col("text"), F.col("s.start"), F.col("s.end")).alias("shown"))


def _digit_sum(column: str, weights: str) -> str:
    return f"list_sum(list_transform(range(1, length({column}) + 1), lambda i: CAST(substr({column}, CAST(i AS BIGINT), 1) AS INT) * {weights}))"


_EAN = f"(10 - {_digit_sum('body', 'CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END')} % 10) % 10"


@query(f"""SELECT c_custkey, full_no[1:3] || '.' || full_no[4:7] || '.' || full_no[8:11] || '.' || full_no[12:13] AS ahvn13, true AS valid FROM (
    SELECT c_custkey, body || CAST({_EAN} AS VARCHAR) AS full_no FROM (SELECT c_custkey, '756' || lpad(CAST((c_custkey * 7919) % 1000000000 AS VARCHAR), 9, '0') AS body FROM customer))""")
def made_ahvn13(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "customer").select("c_custkey", checksums.make_ahvn13(F.col("c_custkey")).alias("ahvn13"))
    return made.withColumn("valid", checksums.valid_ahvn13(F.col("ahvn13")))


@query(f"""SELECT s_suppkey, body || CAST({_EAN} AS VARCHAR) AS gln, true AS valid FROM (SELECT s_suppkey, '7601' || lpad(CAST((s_suppkey * 7919) % 100000000 AS VARCHAR), 8, '0') AS body FROM supplier)""")
def made_gln(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "supplier").select("s_suppkey", checksums.make_gln(F.col("s_suppkey")).alias("gln"))
    return made.withColumn("valid", checksums.valid_gln(F.col("gln")))


@query("""SELECT p_partkey, full_no[1:4] || ' ' || full_no[5:8] || ' ' || full_no[9:12] || ' ' || full_no[13:16] AS card, true AS valid FROM (
    SELECT p_partkey, body || CAST((10 - list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(substr(body, CAST(i AS BIGINT), 1) AS INT) > 4 THEN CAST(substr(body, CAST(i AS BIGINT), 1) AS INT) * 2 - 9
      ELSE CAST(substr(body, CAST(i AS BIGINT), 1) AS INT) * 2 END ELSE CAST(substr(body, CAST(i AS BIGINT), 1) AS INT) END)) % 10) % 10 AS VARCHAR) AS full_no
    FROM (SELECT p_partkey, '4' || lpad(CAST(CAST(p_partkey AS HUGEINT) * 7919 % 100000000000000 AS VARCHAR), 14, '0') AS body FROM part))""")
def made_cards(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "part").select("p_partkey", checksums.make_creditcard(F.col("p_partkey")).alias("card"))
    return made.withColumn("valid", checksums.valid_creditcard(F.col("card")))


@query("""SELECT o_orderkey, 'CH' || check_no || '00762' || acc AS iban, true AS valid FROM (
    SELECT o_orderkey, acc, lpad(CAST(98 - CAST('762' || acc || '121700' AS HUGEINT) % 97 AS VARCHAR), 2, '0') AS check_no
    FROM (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919) % 1000000000000 AS VARCHAR), 12, '0') AS acc FROM orders))""")
def made_ibans(spark: SparkSession, d: str) -> DataFrame:
    made = spread(table(spark, d, "orders").select("o_orderkey")).select("o_orderkey", checksums.make_iban(F.col("o_orderkey")).alias("grouped"))
    return made.select("o_orderkey", F.replace("grouped", F.lit(" "), F.lit("")).alias("iban"), checksums.valid_iban(F.col("grouped")).alias("valid"))


@query("SELECT count(*) AS keys, count(*) AS uid_ok, count(*) AS qr_ok, CAST(0 AS BIGINT) AS uid_broken, CAST(0 AS BIGINT) AS qr_broken FROM customer")
def mutated_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """A changed digit is always found out."""
    made = table(spark, d, "customer").select(checksums.make_uid(F.col("c_custkey")).alias("uid"), checksums.make_qr_reference(F.col("c_custkey")).alias("qr"))
    last = lambda c: F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.pmod(F.substring(c, F.length(c), F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    return made.agg(
        F.count("*").alias("keys"), F.count_if(checksums.valid_uid(F.col("uid"))).alias("uid_ok"), F.count_if(checksums.valid_qr_reference(F.col("qr"))).alias("qr_ok"),
        F.count_if(checksums.valid_uid(last(F.col("uid")))).alias("uid_broken"), F.count_if(checksums.valid_qr_reference(last(F.col("qr")))).alias("qr_broken"),
    )


@query("SELECT kind, name_form, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS weight, count(*) AS n_rows FROM name_weights WHERE name_form IS NOT NULL GROUP BY 1, 2")
def name_totals(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "name_weights").where("name_form is not null")
    return names.groupBy("kind", "name_form").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("weight"), F.count("*").alias("n_rows"))


@query("""SELECT kind, name_form, CAST(sum(w) OVER (PARTITION BY kind ORDER BY name_form) AS BIGINT) AS upto FROM (
    SELECT kind, name_form, sum(greatest(1, CAST(floor(sqrt(greatest(coalesce(weight, 0), 0))) AS INT))) AS w FROM name_weights WHERE name_form IS NOT NULL GROUP BY 1, 2)""")
def name_ranges(spark: SparkSession, d: str) -> DataFrame:
    return generate.weighted(table(spark, d, "name_weights"), "kind", "name_form", "weight")


@query("""SELECT DISTINCT kind, name_form, CAST(('0x' || substr(sha256(name_form), 1, 8))::BIGINT % 10 AS INT) AS zone FROM name_weights WHERE name_form IS NOT NULL""")
def name_zones(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "name_weights").where("name_form is not null").select("kind", "name_form").distinct()
    return names.withColumn("zone", text.zone(F.col("name_form")))


@query("SELECT DISTINCT locality_name, plz, lower(strip_accents(locality_name)) AS sort_key FROM localities")
def plain_localities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "localities").select("locality_name", "plz").distinct().withColumn("sort_key", text.plain_key(F.col("locality_name")))


@query("SELECT s.city, count(DISTINCT s.street_name) AS streets, min(l.plz) AS plz FROM streets s LEFT JOIN (SELECT DISTINCT * FROM localities) l ON l.locality_name = s.city GROUP BY 1")
def streets_of_localities(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "localities").distinct().withColumnRenamed("plz", "l_plz")
    own = table(spark, d, "streets").join(places, F.col("city") == F.col("locality_name"), "left")
    return own.groupBy("city").agg(F.countDistinct("street_name").alias("streets"), F.min("l_plz").alias("plz"))


@query("""SELECT template_id, mark, name, count(*) AS uses FROM (SELECT template_id, regexp_extract(s, '\\{([~@]?)', 1) AS mark, regexp_replace(s, '[{}~@]', '', 'g') AS name
    FROM (SELECT template_id, unnest(regexp_extract_all(text, '\\{[~@]?[A-Za-z0-9_]+\\}')) AS s FROM templates)) GROUP BY 1, 2, 3""")
def template_slots(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "templates").select("template_id", F.explode(generate.slots(F.col("text"))).alias("s"))
    named = slots.select("template_id", F.regexp_extract("s", r"\{([~@]?)", 1).alias("mark"), F.regexp_replace("s", "[{}~@]", "").alias("name"))
    return named.groupBy("template_id", "mark", "name").agg(F.count("*").alias("uses"))


@query(f"""SELECT DISTINCT template_id, name FROM (SELECT template_id, regexp_replace(s, '[{{}}]', '', 'g') AS name FROM (SELECT template_id, unnest(regexp_extract_all(text || ' {{' || upper(regexp_replace(lang, '[^A-Za-z]', '', 'g')) || '_NUMMER}} {{CITY}}', '\\{{[A-Z0-9_]+\\}}')) AS s FROM templates WHERE text IS NOT NULL AND lang IS NOT NULL))
    WHERE name NOT IN ({", ".join(f"'{t}'" for t in STAGES)})""")
def unknown_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots that are no tags, in the templates with one more slot named after their language."""
    more = F.concat(F.lit(" {"), F.upper(F.regexp_replace("lang", "[^A-Za-z]", "")), F.lit("_NUMMER} {CITY}"))
    slots = table(spark, d, "templates").where("text is not null and lang is not null").select("template_id", F.explode(F.regexp_extract_all(F.concat("text", more), F.lit(r"\{[A-Z0-9_]+\}"), F.lit(0))).alias("s"))
    named = slots.select("template_id", F.regexp_replace("s", "[{}]", "").alias("name")).distinct()
    return named.join(F.broadcast(tag_table(spark).select(F.col("tag").alias("name"))), "name", "left_anti").select("template_id", "name")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    masks = table(spark, d, "mask_results").select("doc_id", F.explode("spans").alias("s")).where("s.start_pos < s.end_pos").select("doc_id", "s.tag", "s.start_pos", "s.end_pos", "s.quelle")
    return masks.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("value", text.part(F.col("text"), F.col("start_pos"), F.col("end_pos"))).drop("text")


_GOLD = """gold AS (SELECT m.doc_id, s.tag AS tag, s.start_pos AS start_pos, s.end_pos AS end_pos, s.quelle AS quelle, substr(d.text, s.start_pos + 1, s.end_pos - s.start_pos) AS value
    FROM (SELECT doc_id, unnest(spans) AS s FROM mask_results) m JOIN documents d USING (doc_id) WHERE s.start_pos < s.end_pos)"""
# Predictions to evaluate: those of the model one sign short, those of the rules as they are, propagated ones missing, names
# of every third document under a tag that stays readable, and a place that is no detail.
_PRED = """pred AS (SELECT doc_id, CASE WHEN tag = 'FULLNAME' AND doc_id % 3 = 0 THEN 'CANTON' ELSE tag END AS tag, start_pos, CASE WHEN quelle = 'model' THEN end_pos - 1 ELSE end_pos END AS end_pos FROM gold WHERE quelle <> 'propagation'
    UNION ALL SELECT doc_id, 'CITY', CAST(0 AS INT), CAST(1 AS INT) FROM (SELECT DISTINCT doc_id FROM gold WHERE doc_id % 4 = 0))"""
_SPACE = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_MASKS = ", ".join(f"'{t}'" for t, action in ACTIONS.items() if action == "mask")
_WEIGHT = "CASE g.tag " + " ".join(f"WHEN '{t}' THEN {severity(t) if ACTIONS[t] == 'mask' else 0.0}" for t in STAGES) + " ELSE 0.0 END"
# Gold with its match: copies of a place are numbered on both sides; a prediction of the model is one sign short.
_MATCHED = f"""{_GOLD}, {_PRED}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tag, start_pos, end_pos) AS k FROM gold), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tag, start_pos, end_pos) AS k FROM pred),
    ex AS (SELECT doc_id, tag, start_pos, end_pos, k FROM g JOIN p USING (doc_id, tag, start_pos, end_pos, k)),
    gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tag, start_pos ORDER BY end_pos, k) AS r FROM g ANTI JOIN ex USING (doc_id, tag, start_pos, end_pos, k)),
    pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tag, start_pos ORDER BY end_pos, k) AS r FROM p ANTI JOIN ex USING (doc_id, tag, start_pos, end_pos, k)),
    pa AS (SELECT gr.doc_id, gr.tag, gr.start_pos, gr.end_pos, gr.k, pr.end_pos AS p_end, pr.k AS p_k FROM gr JOIN pr ON gr.doc_id = pr.doc_id AND gr.tag = pr.tag AND gr.start_pos = pr.start_pos AND gr.r = pr.r AND pr.end_pos > gr.start_pos),
    signs AS (SELECT doc_id, tag, start_pos, end_pos, k, value, unnest(range(0, length(value))) AS i FROM g WHERE tag IN ({_MASKS})),
    seen AS (SELECT * FROM signs WHERE NOT regexp_matches(substr(value, CAST(i AS BIGINT) + 1, 1), '{_SPACE}')),
    bare AS (SELECT s.*, EXISTS (SELECT 1 FROM pred p WHERE p.tag IN ({_MASKS}) AND p.doc_id = s.doc_id AND p.start_pos <= s.start_pos + s.i AND s.start_pos + s.i < p.end_pos) AS covered FROM seen s),
    lk AS (SELECT doc_id, tag, start_pos, end_pos, k, count(*) AS significant, count(*) FILTER (NOT covered) AS open_chars FROM bare GROUP BY ALL),
    gold_rows AS (SELECT g.*, coalesce(lk.open_chars, 0) AS open_chars, coalesce(lk.significant, 0) AS significant, {_WEIGHT} AS weight, {_WEIGHT} * coalesce(lk.open_chars, 0) / greatest(1, coalesce(lk.significant, 0)) AS leak_weight,
        CASE WHEN ex.k IS NOT NULL THEN 'exact' WHEN pa.k IS NOT NULL THEN 'partial' ELSE 'missed' END AS verdict
        FROM g LEFT JOIN lk USING (doc_id, tag, start_pos, end_pos, k) LEFT JOIN ex USING (doc_id, tag, start_pos, end_pos, k) LEFT JOIN pa USING (doc_id, tag, start_pos, end_pos, k)),
    pred_rows AS (SELECT p.*, ex.k IS NOT NULL OR pa.p_k IS NOT NULL AS used FROM p LEFT JOIN ex USING (doc_id, tag, start_pos, end_pos, k) LEFT JOIN pa ON p.doc_id = pa.doc_id AND p.tag = pa.tag AND p.start_pos = pa.start_pos AND p.end_pos = pa.p_end AND p.k = pa.p_k),
    tags AS (SELECT tag, count(*) AS gold, CAST(0 AS BIGINT) AS pred, count(*) FILTER (verdict = 'exact') AS exact, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'missed') AS missed, count(*) FILTER (open_chars > 0) AS leaked, sum(leak_weight) AS leak_weight, sum(weight) AS weight FROM gold_rows GROUP BY 1
        UNION ALL SELECT tag, 0, count(*), 0, 0, 0, 0, 0, 0 FROM pred_rows GROUP BY 1),
    counted AS (SELECT tag, sum(gold) AS gold, sum(pred) AS pred, sum(exact) AS exact, sum(partial) AS partial, sum(missed) AS missed, sum(leaked) AS leaked, sum(leak_weight) AS leak_weight, sum(weight) AS weight FROM tags GROUP BY 1)"""


def _pred(gold: DataFrame) -> DataFrame:
    readable = (F.col("tag") == "FULLNAME") & (F.col("doc_id") % 3 == 0)
    own = gold.where("quelle <> 'propagation'").select("doc_id", F.when(readable, "CANTON").otherwise(F.col("tag")).alias("tag"), "start_pos", F.when(F.col("quelle") == "model", F.col("end_pos") - 1).otherwise(F.col("end_pos")).alias("end_pos"))
    return own.unionByName(gold.where("doc_id % 4 = 0").select("doc_id").distinct().select("doc_id", F.lit("CITY").alias("tag"), F.lit(0).alias("start_pos"), F.lit(1).alias("end_pos")))


@query(f"""WITH {_MATCHED} SELECT tag, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, CAST(exact AS BIGINT) AS exact, CAST(partial AS BIGINT) AS partial, CAST(missed AS BIGINT) AS missed, round(coalesce(exact / nullif(pred, 0), 0), 9) AS "precision", round(coalesce(exact / nullif(gold, 0), 0), 9) AS recall,
    round(coalesce(2 * (exact / nullif(pred, 0)) * (exact / nullif(gold, 0)) / nullif(exact / nullif(pred, 0) + exact / nullif(gold, 0), 0), 0), 9) AS f1 FROM counted""")
def tag_scores(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d)
    out = evaluate.per_tag(gold, _pred(gold))
    return out.select("tag", "gold", "pred", "exact", "partial", "missed", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_GOLD}, {_PRED} SELECT g.tag, count(*) AS met FROM (SELECT DISTINCT doc_id, tag, start_pos, end_pos FROM gold) g
    WHERE EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.tag = g.tag AND g.start_pos < p.end_pos AND p.start_pos < g.end_pos) GROUP BY 1""")
def tag_overlaps(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d)
    return evaluate.overlapping(gold, _pred(gold)).groupBy("tag").agg(F.count("*").alias("met"))


@query(f"""WITH {_MATCHED} SELECT tag, count(*) AS spans, CAST(sum(significant) AS BIGINT) AS significant, CAST(sum(open_chars) AS BIGINT) AS open_chars, count(*) FILTER (open_chars > 0) AS leaked, round(sum(leak_weight), 6) AS leak_weight, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM gold_rows GROUP BY 1""")
def tag_leaks(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d)
    out = evaluate.leaks(gold, _pred(gold)).groupBy("tag")
    return out.agg(F.count("*").alias("spans"), F.sum("significant").cast("bigint").alias("significant"), F.sum("open_chars").cast("bigint").alias("open_chars"), F.count_if(F.col("open_chars") > 0).alias("leaked"), F.round(F.sum("leak_weight"), 6).alias("leak_weight"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""WITH {_MATCHED} SELECT CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(pred) AS BIGINT) AS pred, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(leaked) AS BIGINT) AS leaked, (SELECT count(*) FROM pred_rows WHERE NOT used) AS over,
    round(sum(leak_weight) / sum(weight), 9) AS leak_rate, round(2 * (sum(exact) / sum(pred)) * (sum(exact) / sum(gold)) / (sum(exact) / sum(pred) + sum(exact) / sum(gold)), 9) AS micro_f1 FROM counted""")
def evaluation_totals(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d)
    return evaluate.totals(gold, _pred(gold)).select("gold", "pred", "exact", "leaked", "over", F.round("leak_rate", 9).alias("leak_rate"), F.round("micro_f1", 9).alias("micro_f1"))


@query(f"""WITH {_MATCHED} SELECT doc_id, tag, start_pos, end_pos, count(*) AS n FROM pred_rows WHERE NOT used GROUP BY ALL""")
def over_masking(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d)
    return evaluate.over(gold, _pred(gold)).groupBy("doc_id", "tag", "start_pos", "end_pos").agg(F.count("*").alias("n"))


@query(f"""WITH {_MATCHED} SELECT rank, tag, leaked, missed FROM (SELECT tag, CAST(leaked AS BIGINT) AS leaked, CAST(missed AS BIGINT) AS missed, row_number() OVER (ORDER BY leaked DESC, missed DESC, tag) AS rank FROM counted) WHERE rank <= 5""")
def worst_tags(spark: SparkSession, d: str) -> DataFrame:
    """The top of the report: a limit is its feature."""
    gold = _gold(spark, d)
    top = evaluate.report(gold, _pred(gold)).limit(5).select("tag", "leaked", "missed")
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("leaked"), F.desc("missed"), "tag")).cast("bigint"))


@query(f"""WITH {_GOLD}, {_PRED}, w AS (SELECT DISTINCT doc_id, tag, start_pos, end_pos FROM gold),
    j AS (SELECT w.*, bool_or(p.tag = w.tag AND p.start_pos <= w.start_pos AND p.end_pos >= w.end_pos) AS r, bool_or(p.start_pos < w.end_pos AND w.start_pos < p.end_pos) AS t, string_agg(DISTINCT CASE WHEN p.start_pos < w.end_pos AND w.start_pos < p.end_pos THEN p.tag END, ', ' ORDER BY CASE WHEN p.start_pos < w.end_pos AND w.start_pos < p.end_pos THEN p.tag END) AS instead
    FROM w LEFT JOIN pred p ON p.doc_id = w.doc_id GROUP BY w.doc_id, w.tag, w.start_pos, w.end_pos)
    SELECT tag, CASE WHEN r THEN 'right' WHEN t THEN 'label' ELSE 'leak' END AS verdict, CASE WHEN NOT coalesce(r, false) AND t THEN instead END AS instead, count(*) AS n FROM j GROUP BY ALL""")
def containment_verdicts(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d)
    return evaluate.containment(gold, _pred(gold)).groupBy("tag", "verdict", "instead").agg(F.count("*").alias("n"))


@query(f"""WITH {_GOLD} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(doctype) = 0 THEN 'doctype' WHEN grouping(tag) = 0 THEN 'tag' ELSE 'all' END AS grp, lang, doctype, tag, count(*) AS spans, count(DISTINCT doc_id) AS docs
    FROM gold JOIN (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(doctype, '?') AS doctype FROM documents) USING (doc_id) GROUP BY GROUPING SETS ((lang), (doctype), (tag), ())""")
def span_reports(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("doctype", F.lit("?")).alias("doctype"))
    out = evaluate.grouped(_gold(spark, d).drop("value").join(docs, "doc_id"), ["lang", "doctype", "tag"], {"spans": F.count("*"), "docs": F.countDistinct("doc_id")})
    return out.select("grp", "lang", "doctype", "tag", "spans", "docs")


# Scores for the queries on thresholds, from the place alone.
_SCORE = "((doc_id * 31 + start_pos * 17) % 100) / 100.0"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).withColumn("score", F.pmod(F.col("doc_id") * 31 + F.col("start_pos") * 17, F.lit(100)) / 100.0).withColumn("is_gold", F.col("quelle") == "model")


@query(f"""WITH {_GOLD}, s AS (SELECT tag, {_SCORE} AS score, quelle = 'model' AS is_gold FROM gold) SELECT tag, CAST(level AS DOUBLE) AS level, count(*) FILTER (is_gold AND score < level) AS leaks, count(*) FILTER (NOT is_gold AND score >= level) AS over
    FROM s, (SELECT unnest([{", ".join(f"{x:.1f}" for x in evaluate.LEVELS)}]) AS level) GROUP BY 1, 2""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sweep(_scored(spark, d))


@query(f"""WITH {_GOLD}, s AS (SELECT tag, CAST({_SCORE} AS DOUBLE) AS score FROM gold), r AS (SELECT tag, score, row_number() OVER (PARTITION BY tag ORDER BY score) AS k, count(*) OVER (PARTITION BY tag) AS n FROM s)
    SELECT tag, min(score) AS least, min(score) FILTER (k = n // 2 + 1) AS upper_median, count(*) AS n FROM r GROUP BY 1""")
def confidence_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confidence(_scored(spark, d))


_LIMIT = "CASE tag " + " ".join(f"WHEN '{t}' THEN {x}" for t, x in THRESHOLDS.items()) + " ELSE -1 END"


@query(f"""WITH {_GOLD} SELECT tag, count(*) FILTER (score >= lim) AS kept, count(*) FILTER (score < lim) AS dropped FROM (SELECT tag, CAST({_SCORE} AS DOUBLE) AS score, CAST({_LIMIT} AS DOUBLE) AS lim FROM gold) GROUP BY 1""")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    limit = spans.lookup(THRESHOLDS, F.col("tag"), -1.0)
    return _scored(spark, d).groupBy("tag").agg(F.count_if(F.col("score") >= limit).alias("kept"), F.count_if(F.col("score") < limit).alias("dropped"))


@query("SELECT event_type AS \"condition\", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, CASE WHEN count(value) < 2 THEN 'none' WHEN count(value) < 3 THEN 'few' ELSE 'ok' END AS note FROM events GROUP BY 1")
def run_variance(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.variance(table(spark, d, "events").withColumnRenamed("event_type", "condition"), "condition", "value")
    return out.select("condition", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "note")


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS c, o_totalprice AS v FROM orders), v AS (SELECT c, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n FROM r GROUP BY 1)
    SELECT a.c AS a, b.c AS b, round(b.mean - a.mean, 4) AS delta, round(greatest(a.sd, b.sd), 4) AS sd, round(abs(b.mean - a.mean) / greatest(a.sd, b.sd), 6) AS times, CASE WHEN abs(b.mean - a.mean) > 2 * greatest(a.sd, b.sd) THEN 'clear' WHEN abs(b.mean - a.mean) > greatest(a.sd, b.sd) THEN 'weak' ELSE 'unresolved' END AS verdict, least(a.n, b.n) < 3 AS few FROM v a, v b WHERE a.c < b.c""")
def run_difference(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("condition"), F.col("o_totalprice").alias("value"))
    out = evaluate.differences(runs, "condition", "value")
    return out.select("a", "b", F.round("delta", 4).alias("delta"), F.round("sd", 4).alias("sd"), F.round("times", 6).alias("times"), "verdict", "few")


@query("""WITH v AS (SELECT event_type AS c, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM events GROUP BY 1), s AS (SELECT c_custkey AS run, c_acctbal AS value FROM customer)
    SELECT run, c AS event_type, round((value - mean) / sd, 6) AS z FROM s, v WHERE n >= 3""")
def single_runs(spark: SparkSession, d: str) -> DataFrame:
    single = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.col("c_acctbal").alias("value"))
    return evaluate.against(single, table(spark, d, "events"), "event_type", "value").select("run", "event_type", F.round("z", 6).alias("z"))


_NOW = ", ".join(f"('{t}', {x})" for t, x in THRESHOLDS.items())


@query(f"""WITH {_GOLD}, s AS (SELECT tag, {_SCORE} AS score, quelle = 'model' AS is_gold FROM gold), e AS (SELECT * FROM s WHERE tag IN (SELECT tag FROM s GROUP BY 1 HAVING count(*) FILTER (is_gold) >= 5)),
    w AS (SELECT tag, CAST(level AS DOUBLE) AS level, count(*) FILTER (is_gold AND score < level) AS leaks, count(*) FILTER (NOT is_gold AND score >= level) AS over FROM e, (SELECT unnest([{", ".join(f"{x:.1f}" for x in evaluate.LEVELS)}]) AS level) GROUP BY 1, 2),
    now AS (SELECT * FROM (VALUES {_NOW}) t(tag, lim)), n AS (SELECT w.tag, min(leaks) AS leaks, min(over) AS over FROM w JOIN now ON w.tag = now.tag AND abs(level - lim) < 1e-9 GROUP BY 1),
    b AS (SELECT tag, min(struct_pack(leaks := leaks, over := over, level := level)) AS b, max(over) - min(over) < 3 AS flat FROM w GROUP BY 1)
    SELECT b.tag, b.b.level AS best, b.b.leaks AS leaks, b.b.over AS over, flat, (SELECT min(level) FROM w WHERE w.tag = b.tag AND w.leaks > n.leaks) AS tips, CASE WHEN n.tag IS NOT NULL THEN NOT flat AND (b.b.leaks < n.leaks OR b.b.leaks = n.leaks AND b.b.over < n.over) END AS better FROM b LEFT JOIN n USING (tag)""")
def best_levels(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_level(evaluate.sweep(evaluate.enough_gold(_scored(spark, d))), THRESHOLDS)


@query(f"""WITH {_GOLD}, v AS (SELECT doc_id, tag, value, substr(value, 1, 3) AS canonical, min(start_pos) AS first_pos FROM gold WHERE tag <> 'CANTON' GROUP BY 1, 2, 3, 4), gr AS (SELECT doc_id, tag, canonical, min(first_pos) AS g_pos FROM v GROUP BY 1, 2, 3),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tag ORDER BY g_pos) AS no FROM gr), k AS (SELECT v.*, row_number() OVER (PARTITION BY doc_id, tag, canonical ORDER BY value <> canonical, first_pos) AS k FROM v)
    SELECT k.doc_id, k.tag, k.value, '[' || k.tag || '_' || CAST(no AS VARCHAR) || CASE WHEN k > 1 THEN chr(CAST(95 + k AS INT)) ELSE '' END || ']' AS placeholder FROM k JOIN n USING (doc_id, tag, canonical)""")
def placeholder_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers by tag in order of appearance, letters for the variants of one canonical form (here: its first three signs)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    masks = spread(table(spark, d, "mask_results").select("doc_id", "spans")).join(docs, "doc_id")
    value = lambda s: text.part(F.col("text"), s["start_pos"], s["end_pos"])
    own = F.transform(F.filter("spans", lambda s: s["start_pos"] < s["end_pos"]), lambda s: F.struct(s["tag"].alias("tag"), s["start_pos"].alias("start"), s["end_pos"].alias("end"), F.substring(value(s), 1, 3).alias("canonical"), s["quelle"].alias("source")))
    entries = masks.select("doc_id", F.explode(mask.numbered(F.col("text"), own)).alias("e"))
    return entries.select("doc_id", "e.tag", "e.value", "e.placeholder").distinct()


@query("""SELECT mask_id, CASE WHEN dictionary IS NULL THEN text ELSE list_reduce(list_prepend(text, list_transform(list_filter(map_entries(dictionary), lambda e: e.value IS NOT NULL), lambda e: e.key || chr(1) || e.value)),
    lambda t, e: replace(t, split_part(e, chr(1), 1), split_part(e, chr(1), 2))) END AS restored FROM mask_results""")
def restored_texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "mask_results")).select("mask_id", mask.restore(F.col("text"), F.col("dictionary")).alias("restored"))


@query("""WITH p AS (SELECT DISTINCT mask_id, unnest(regexp_extract_all(text, '\\[[A-Za-z][A-Za-z0-9_]*_[0-9]+[a-z]*\\]')) AS ph FROM mask_results),
    k AS (SELECT mask_id, unnest(map_entries(dictionary)) AS e FROM mask_results WHERE dictionary IS NOT NULL)
    SELECT p.mask_id, count(*) AS found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.mask_id = p.mask_id AND k.e.key = p.ph AND k.e.value IS NOT NULL)) AS missing FROM p GROUP BY 1""")
def restore_gaps(spark: SparkSession, d: str) -> DataFrame:
    report = spread(table(spark, d, "mask_results")).select("mask_id", mask.restore_report(F.col("text"), F.col("dictionary")).alias("r"))
    return report.select("mask_id", (F.col("r.restored") + F.size("r.missing")).cast("bigint").alias("found"), F.size("r.missing").cast("bigint").alias("missing")).where("found > 0")


@query("""WITH s AS (SELECT example_id, s.start_pos AS a, s.end_pos AS b FROM (SELECT DISTINCT example_id, unnest(spans) AS s FROM examples)), f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY example_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
    i AS (SELECT *, sum(n) OVER (PARTITION BY example_id ORDER BY a, b) AS k FROM f) SELECT example_id, min(a) AS start_pos, max(b) AS end_pos FROM i GROUP BY example_id, k""")
def span_islands(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "examples").select("example_id", F.explode("spans").alias("s")).select("example_id", "s.*").distinct()
    return spans.islands(own, ["example_id"], "start_pos", "end_pos").select("example_id", "start_pos", "end_pos")


@query("""SELECT example_id, start_pos, end_pos, next_start, next_start < end_pos AS overlaps FROM (SELECT example_id, s.start_pos AS start_pos, s.end_pos AS end_pos, lead(s.start_pos) OVER (PARTITION BY example_id ORDER BY s.start_pos, s.end_pos) AS next_start
    FROM (SELECT DISTINCT example_id, unnest(spans) AS s FROM examples)) WHERE next_start <= end_pos""")
def touching_spans(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    own = table(spark, d, "examples").select("example_id", F.explode("spans").alias("s")).select("example_id", "s.*").distinct()
    following = F.lead("start_pos").over(Window.partitionBy("example_id").orderBy("start_pos", "end_pos"))
    return own.withColumn("next_start", following).where("next_start <= end_pos").select("example_id", "start_pos", "end_pos", "next_start", (F.col("next_start") < F.col("end_pos")).alias("overlaps"))


@query("SELECT s.tag AS tag, count(*) AS spans, count(DISTINCT example_id) AS examples FROM (SELECT example_id, unnest(spans) AS s FROM examples) GROUP BY 1")
def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "examples").select("example_id", F.explode("spans.tag").alias("tag"))
    return own.groupBy("tag").agg(F.count("*").alias("spans"), F.countDistinct("example_id").alias("examples"))


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 60 THEN 1 ELSE 1 + CAST(ceil((n - 60) / 45.0) AS INT) END)) AS k FROM t)
    SELECT doc_id, CAST(n AS INT) AS tokens, CAST(45 * k AS INT) AS first_token, CAST(least(45 * k + 60, n) AS INT) AS last_token FROM w""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of sixty tokens, fifteen of which overlap, over runs of letters and digits."""
    own = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    sized = own.select("doc_id", F.size(text.matches(F.col("text"), "[A-Za-z0-9]+")).alias("tokens"))
    rows = sized.select("doc_id", "tokens", F.explode(labels.windows(F.col("tokens"), 60, 45)).alias("w"))
    return rows.select("doc_id", "tokens", F.col("w.start").alias("first_token"), F.col("w.end").alias("last_token"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?i)</(?:p|div|tr|li|h[1-6]|table|blockquote)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&ouml;', 'ö'), '&amp;', '&'),
    '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS plain
    FROM (SELECT doc_id, '<div><b>' || replace(text, '&', '&amp;') || '</b></div><SCRIPT type="x">if (a < b) {{ c() }}' || chr(10) || '</SCRIPT><p class="y">K&ouml;niz &amp;amp; Bern</p>' || chr(10) AS html FROM documents WHERE text IS NOT NULL)""")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    html = F.concat(F.lit("<div><b>"), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit('</b></div><SCRIPT type="x">if (a < b) { c() }\n</SCRIPT><p class="y">K&ouml;niz &amp;amp; Bern</p>\n'))
    return docs.select("doc_id", text.html_to_text(html).alias("plain"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(?:Einsprache|Beschwerde|opposition|recours|ricorso|appeal)\\b')) AS hits FROM documents WHERE regexp_matches(text, '(?i)\\b(?:Einsprache|Beschwerde|opposition|recours|ricorso|appeal)\\b')""")
def word_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    own = rules.load([{"id": "rechtsmittel", "placeholder": "Rechtsmittel", "type": "words", "words": ["Einsprache", "Beschwerde", "opposition", "recours", "ricorso", "appeal"], "ignore_case": True}])
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size(rules.apply(F.col("text"), own)).cast("bigint").alias("hits")).where("hits > 0")


@query(f"SELECT '{label_hash()}' AS label_hash, 45 AS tags, 91 AS labels")
def label_contract(spark: SparkSession, d: str) -> DataFrame:
    tags = tag_table(spark).agg(F.count("*").cast("int").alias("tags"), F.array_join(F.concat(F.array(F.lit("O")), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("index", "tag"))), lambda t: F.array(F.concat(F.lit("B-"), t["tag"]), F.concat(F.lit("I-"), t["tag"]))))), "\n").alias("joined"))
    return tags.select(F.sha2("joined", 256).alias("label_hash"), "tags", F.size(F.split("joined", "\n")).alias("labels"))


@query(f"""SELECT time_bucket(INTERVAL '1 day', received_at) AS window_start, 'EMAIL' AS tag, CAST(sum(len(regexp_extract_all(text, '{RULES["EMAIL"].pattern}'))) AS BIGINT) AS details FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING sum(len(regexp_extract_all(text, '{RULES["EMAIL"].pattern}'))) > 0""")
def details_by_day(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text is not null").select(F.col("received_at").cast("timestamp").alias("received_at"), "text"))
    out = details_per_window(docs, "received_at", "text", "1 day", names=("EMAIL",))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tag", "details")


@query()
def recognised_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(recognised("text")).alias("s")).select("doc_id", "s.tag", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


@query()
def masked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Recognise, resolve, follow through the document, number, replace: the whole chain."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("spans", recognised("text"))
    return mask.mask_table(docs, "text", "spans").select("doc_id", "masked", F.map_entries("dictionary").alias("dictionary"))


# A text in which letters stand for their kind, as SQL's patterns only know those of ASCII; every sign keeps its place.
_UPPER, _LOWER = "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xDF)))), "".join(map(chr, (*range(0xE0, 0xF7), *range(0xF8, 0x100))))
_BLANKS = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\u0085"
_WIDE = "".join(map(chr, range(0xFF10, 0xFF1A)))
_OTHER = "[ªµºß²³¹\\x{0100}-\\x{02FF}\\x{0370}-\\x{0482}\\x{048A}-\\x{058F}\\x{1E00}-\\x{1FFF}\\x{2C00}-\\x{2DFF}\\x{A640}-\\x{A7FF}\\x{FB00}-\\x{FB06}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]"


def kinds_sql(column: str) -> str:
    source = _UPPER + _LOWER + _BLANKS + _WIDE
    to = "A" * len(_UPPER) + "a" * len(_LOWER) + chr(9) * len(_BLANKS) + "0123456789"
    return f"regexp_replace(translate({column}, '{source}', '{to}'), '{_OTHER}', '_', 'g')"


_NETS = {"Ziffernfolge": "\\b\\d[\\d'.\\- ]{3,}\\d\\b", "Grossschreibung": "\\b[A-Z][a-z'’\\-]{2,}(?: +[A-Z][a-z'’\\-]{2,}){0,2}\\b", "Adresszeichen": "\\S+@\\S+|https?://\\S+|\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b", "Pfad": r"(?:[A-Z]:\\|/)(?:[\w.\-]+[/\\]){1,}[\w.\-]*"}
_HITS = " UNION ALL ".join(f"SELECT *, {rank} AS rank, '{kind}' AS kind FROM ({matches_sql(p, 't', 'mask_id', 'own')})" for rank, (kind, p) in enumerate(_NETS.items()))


@query(f"""WITH RECURSIVE own AS (SELECT mask_id, d.text AS x, {kinds_sql("d.text")} AS t, m.spans AS spans FROM mask_results m JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL),
    c AS (SELECT mask_id, s.start_pos AS a, s.end_pos AS b FROM (SELECT mask_id, unnest(spans) AS s FROM own)), h AS ({_HITS}),
    v AS (SELECT h.mask_id, start_pos, end_pos, rank, kind, substr(x, start_pos + 1, end_pos - start_pos) AS value, regexp_replace(substr(x, 1, start_pos), '{_SPACE}+$', '') AS before FROM h JOIN own USING (mask_id)),
    f AS (SELECT * FROM v WHERE EXISTS (SELECT 1 FROM (SELECT unnest(range(v.start_pos, v.end_pos)) AS i) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.mask_id = v.mask_id AND c.a <= i AND i < c.b))
        AND NOT (kind = 'Grossschreibung' AND (split_part(value, ' ', 1) IN ({", ".join(f"'{w}'" for w in suspicion.HARMLESS)}) OR value NOT LIKE '% %' AND (before = '' OR right(before, 1) IN ('.', '!', '?', ':'))))),
    o AS (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY start_pos, rank) AS n FROM f),
    k AS (SELECT mask_id, n, end_pos FROM o WHERE n = 1 UNION ALL SELECT k.mask_id, (SELECT min(o.n) FROM o WHERE o.mask_id = k.mask_id AND o.n > k.n AND o.start_pos >= k.end_pos), (SELECT arg_min(o.end_pos, o.n) FROM o WHERE o.mask_id = k.mask_id AND o.n > k.n AND o.start_pos >= k.end_pos) FROM k WHERE k.n IS NOT NULL)
    SELECT o.mask_id, o.kind, o.start_pos, o.end_pos, o.value FROM o JOIN k ON o.mask_id = k.mask_id AND o.n = k.n""")
def suspicious_rest(spark: SparkSession, d: str) -> DataFrame:
    masks = spread(table(spark, d, "mask_results").select("mask_id", "doc_id", "spans")).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    own = F.transform("spans", lambda s: F.struct(s["start_pos"].alias("start"), s["end_pos"].alias("end")))
    found = masks.select("mask_id", F.explode(suspicion.suspicious(F.col("text"), own)).alias("s"))
    return found.select("mask_id", "s.kind", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), "s.value")


def values(spark: SparkSession, d: str, zone: str | None = None) -> synthesis.Values:
    """Names, places and streets of the tables; street and place come from one record."""
    names = table(spark, d, "name_weights").select(F.when(F.col("kind") == "given", "GIVENNAME").otherwise("FULLNAME").alias("tag"), F.col("name_form").alias("name"), "weight")
    places = table(spark, d, "localities").distinct().select(F.lit("CITY").alias("tag"), F.col("locality_name").alias("name"), F.lit(1).cast("bigint").alias("weight"))
    streets = table(spark, d, "streets").select(F.col("street_name").alias("name"), "plz", "city")
    roads = streets.select(F.lit("STREET").alias("tag"), "name", F.lit(1).cast("bigint").alias("weight")).distinct()
    firms = streets.select(F.lit("ORG").alias("tag"), F.concat("city", F.lit(" Treuhand AG")).alias("name"), F.lit(1).cast("bigint").alias("weight")).where("name is not null").distinct()
    return synthesis.values_from(names.unionByName(places).unionByName(roads).unionByName(firms), streets, zone)


@query("SELECT template_id, true AS whole, len(regexp_extract_all(text, '\\{[A-Za-z0-9_]+\\}')) AS spans, len(regexp_extract_all(text, '\\{~[A-Za-z0-9_]+\\}')) AS decoys, false AS slots_left FROM templates WHERE text IS NOT NULL")
def filled_templates(spark: SparkSession, d: str) -> DataFrame:
    """Every template filled from the tables: all slots have a value, and every span holds what its place in the template says."""
    rows = table(spark, d, "templates").select("template_id", "text", "lang")
    made = synthesis.inject_table(rows, "template_id", "text", "lang", values(spark, d))
    kept = F.split("template", r"\{[~@]?[A-Za-z0-9_]+\}", -1)
    places = F.array_sort(F.concat(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))), F.transform("decoys", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))))
    starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p["b"]))
    ends = F.concat(F.transform(places, lambda p: p["a"]), F.array(F.length("text")))
    between = F.zip_with(starts, ends, lambda a, b: text.part(F.col("text"), a, b))
    return made.select(F.col("id").alias("template_id"), (between == kept).alias("whole"), F.size("spans").cast("bigint").alias("spans"), F.size("decoys").cast("bigint").alias("decoys"), F.col("text").rlike(r"\{[~@]?[A-Za-z0-9_]+\}").alias("slots_left"))


@query()
def generated_examples(spark: SparkSession, d: str) -> DataFrame:
    """As many examples as there are customers, with a tenth of the names damaged, from values outside the held-out zone."""
    n = table(spark, d, "customer").count()
    return synthesis.generate(spark, table(spark, d, "templates"), values(spark, d, "training"), n, seed=7, noise=0.1)


@query("""SELECT template_id, 'unknown slot ' || regexp_extract(s, '\\{([~@]?)', 1) || regexp_replace(s, '[{}~@]', '', 'g') AS finding FROM (SELECT template_id, unnest(list_distinct(regexp_extract_all(text || ' {NOPE} {@nope}', '\\{[~@]?[A-Za-z0-9_]+\\}'))) AS s FROM templates WHERE text IS NOT NULL)
    WHERE s IN ('{NOPE}', '{@nope}') UNION ALL SELECT template_id, 'missing AHVN13' FROM templates WHERE text IS NOT NULL AND NOT contains(text, '{AHVN13}')""")
def template_findings(spark: SparkSession, d: str) -> DataFrame:
    """Templates with two unknown slots added, and without a tag that is asked for; equal slots side by side aside."""
    rows = table(spark, d, "templates").where("text is not null").select("template_id", F.concat("text", F.lit(" {NOPE} {@nope}")).alias("text"))
    return synthesis.check_templates(rows, ("AHVN13",)).where("finding not like 'equal%' and finding not like 'label%'")


_TOKENS = matches_sql("[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]", "t", "example_id", "x")


@query(f"""WITH e AS (SELECT DISTINCT ON (example_id) example_id, text, spans FROM examples WHERE text IS NOT NULL), x AS (SELECT example_id, {kinds_sql("text")} AS t FROM e), tok AS ({_TOKENS}),
    s AS (SELECT example_id, unnest(spans) AS s, unnest(range(1, len(spans) + 1)) AS k FROM e), ss AS (SELECT example_id, s.tag AS tag, s.start_pos AS a, s.end_pos AS b, k FROM s WHERE s.tag IS NOT NULL),
    hit AS (SELECT tok.example_id, tok.start_pos, min(struct_pack(a := ss.a, b := ss.b, k := ss.k, tag := ss.tag)) AS h FROM tok JOIN ss ON ss.example_id = tok.example_id AND ss.a < tok.end_pos AND tok.start_pos < ss.b GROUP BY 1, 2),
    lab AS (SELECT tok.example_id, tok.start_pos, CASE WHEN h IS NULL THEN 'O' WHEN row_number() OVER (PARTITION BY tok.example_id, h ORDER BY tok.start_pos) = 1 THEN 'B-' || h.tag ELSE 'I-' || h.tag END AS label FROM tok LEFT JOIN hit ON hit.example_id = tok.example_id AND hit.start_pos = tok.start_pos)
    SELECT e.example_id, CAST(count(label) AS INT) AS tokens, coalesce(string_agg(label, ' ' ORDER BY start_pos), '') AS labels FROM e LEFT JOIN lab ON lab.example_id = e.example_id GROUP BY 1""")
def token_labels(spark: SparkSession, d: str) -> DataFrame:
    own = F.transform(F.coalesce("spans", F.array().cast("array<struct<tag:string,start_pos:int,end_pos:int>>")), lambda s: F.struct(s["tag"].alias("tag"), s["start_pos"].alias("start"), s["end_pos"].alias("end")))
    rows = spread(table(spark, d, "examples").where("text is not null").select("example_id", "text", own.alias("own"))).dropDuplicates(["example_id"]).withColumn("toks", labels.tokens(F.col("text")))
    return rows.withColumn("labels", labels.align(F.col("toks"), F.col("own"))).select("example_id", F.size("toks").alias("tokens"), F.array_join("labels", " ").alias("labels"))


@query(f"""WITH e AS (SELECT DISTINCT example_id, text, spans FROM examples WHERE text IS NOT NULL AND spans IS NOT NULL), w AS ({matches_sql("[^" + _SPACE[1:-1] + "]+", "text", "example_id", "e")}),
    s AS (SELECT example_id, unnest(spans) AS s, unnest(range(1, len(spans) + 1)) AS k FROM e),
    f AS (SELECT w.example_id, w.start_pos, w.value, min(struct_pack(k := s.k, tag := s.s.tag, start_pos := s.s.start_pos)) AS h FROM w JOIN s ON s.example_id = w.example_id AND s.s.start_pos <= w.start_pos AND w.end_pos <= s.s.end_pos GROUP BY ALL)
    SELECT example_id, CASE WHEN h.start_pos = start_pos THEN 'B-' ELSE 'I-' END || h.tag AS label, value AS word, count(*) AS n FROM f GROUP BY ALL""")
def word_labels(spark: SparkSession, d: str) -> DataFrame:
    """Words inside spans with their label; examples that were delivered again count once."""
    rows = spread(table(spark, d, "examples").where("text is not null and spans is not null").select("example_id", "text", "spans")).distinct()
    own = F.transform("spans", lambda s: F.struct(s["tag"].alias("tag"), s["start_pos"].alias("start"), s["end_pos"].alias("end")))
    words = rows.select("example_id", F.explode(labels.word_labels(F.col("text"), own)).alias("w")).select("example_id", "w.label", "w.word").where("label <> 'O'")
    return words.groupBy("example_id", "label", "word").agg(F.count("*").alias("n"))


from . import editing, recognition  # noqa: E402, F401  (they add their queries)
