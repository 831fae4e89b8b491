"""Queries of the question layer, measures, graph and personal data over the test tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii, rules
from ..operators import chunks, graph, measures, questions, refine
from ..operators import ledger as ops
from .chunks import _ENTITY, _RECURRING, RICH_SQL, _monthly, rich_ledger

CATEGORIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: What is not saved on, in the fixture.
KEPT = ("1-URGENT",)
TERMS = ["weekday:3", "2-high"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


# -- questions

_ASKED = (*questions.EXAMPLES, "¿Cuánto gasté en 2-high en mayo?", "Lista compras de 5-LOW más de 250.50")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.routed(spark.createDataFrame([(q,) for q in _ASKED], "question string"), list(CATEGORIES))


def _routed_sql() -> str:
    text = "translate(lower(question), 'áéíóúüñ¿?¡!', 'aeiouun')"
    kinds = " ".join(f"WHEN regexp_matches(p, '{w}') THEN '{v}'" for v, w in questions.INTENTS)
    names = " ".join(f"WHEN contains(p, '{c.lower()}') THEN '{c}'" for c in CATEGORIES)
    months = " ".join(f"WHEN regexp_matches(p, '\\b{m}\\b') THEN {i}" for i, m in enumerate(questions.MONTHS, 1))
    return f"""WITH q AS (SELECT *, {text} AS p FROM (VALUES {_values((q,) for q in _ASKED)}) v(question)), r AS (SELECT *, regexp_extract(p, '(?:mayor(?:es)?|mas) (?:de|a|que) (\\d+(?:\\.\\d+)?)', 1) AS l FROM q)
      SELECT question, CASE {kinds} ELSE 'search' END AS type, CASE {names} END AS category, (CASE {months} END)::INTEGER AS month, CASE WHEN l <> '' THEN l::DOUBLE END AS least, contains(p, 'fin de semana') AS weekend, contains(p, 'recurrente') AS recurring FROM r"""


_AGGREGATION = f"""{RICH_SQL}, g AS (SELECT category, grouping(category) AS a, round(sum(-amount), 2) AS value, count(*) AS transactions FROM ledger WHERE amount < 0 GROUP BY ROLLUP (category))
  SELECT CASE WHEN a = 0 THEN category END AS category, value, transactions, 'Gasto total' || CASE WHEN a = 0 THEN ' en ' || category ELSE '' END || ': €' || printf('%.2f', value) || ' (' || transactions::VARCHAR || ' transacciones)' AS answer FROM g"""
_PATTERNS = f"""{RICH_SQL}{_ENTITY}{_RECURRING}, c AS (SELECT category, round(sum(-amount), 2) AS s FROM ledger WHERE amount < 0 GROUP BY category ORDER BY s DESC, category LIMIT 3)
  SELECT (SELECT string_agg(category || ' ' || printf('%.2f', s), ', ' ORDER BY s DESC, category) FROM c) AS top_categories, total AS recurring_total FROM s"""
_SAVINGS = f"""{RICH_SQL}, m AS (SELECT count(DISTINCT (year, month)) AS months FROM ledger), g AS (SELECT category, sum(-amount) AS s FROM ledger WHERE amount < 0 AND category NOT IN ('1-URGENT') GROUP BY category)
  SELECT category, round(s / months, 2) AS monthly, round(s / months * 0.2::DOUBLE, 2) AS potential FROM g, m"""
_TREND = f"""{RICH_SQL}, g AS (SELECT strftime(date, '%Y-%m') AS month, round(coalesce(sum(-amount) FILTER (amount < 0), 0), 2) AS spent FROM ledger GROUP BY 1), h AS (SELECT *, lag(spent) OVER (ORDER BY month) AS before FROM g),
  k AS (SELECT *, CASE WHEN before > 0 THEN round(100.0::DOUBLE * (spent - before) / before, 4) END AS change FROM h) SELECT *, CASE WHEN change > 5 THEN 'creciente' WHEN change < -5 THEN 'decreciente' WHEN change IS NOT NULL THEN 'estable' END AS trend FROM k"""
_DEMO = f"""{RICH_SQL}, a AS (SELECT round(sum(-amount) FILTER (amount < 0), 2) AS expenses, round(sum(amount) FILTER (amount > 0), 2) AS income FROM ledger),
  c AS (SELECT category, round(sum(-amount), 2) AS spent FROM ledger WHERE amount < 0 GROUP BY category ORDER BY spent DESC, category LIMIT 3)
  SELECT (row_number() OVER (ORDER BY spent DESC, category))::INTEGER AS rank, category, spent, round(100.0::DOUBLE * spent / expenses, 4) AS share, expenses, income, round(income - expenses, 2) AS balance FROM c, a"""
_SEARCH = f"{RICH_SQL} SELECT txn_id, merchant, amount FROM ledger WHERE category = '2-HIGH' AND month = 7 AND abs(amount) > 100 AND weekday >= 5"
_SEARCH_RECURRING = f"{RICH_SQL}{_ENTITY} SELECT txn_id, merchant, amount FROM ledger WHERE merchant IN (SELECT merchant FROM k WHERE kind IS NOT NULL)"

# -- graph: merchants, categories and weekdays of the ledger

_EDGES = f"""{RICH_SQL}, t AS (SELECT DISTINCT 'merchant:' || merchant AS m, 'category:' || category AS c, 'weekday:' || weekday::VARCHAR AS d FROM ledger WHERE merchant IS NOT NULL UNION SELECT DISTINCT NULL, 'category:' || category, 'weekday:' || weekday::VARCHAR FROM ledger),
  e AS (SELECT m AS src, c AS dst, 'BELONGS_TO' AS relation FROM t WHERE m IS NOT NULL UNION SELECT m, d, 'OCCURRED_ON' FROM t WHERE m IS NOT NULL UNION SELECT c, d, 'AGGREGATES_TO' FROM t),
  p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), z AS (SELECT a AS id, b AS other FROM p UNION ALL SELECT b, a FROM p), v AS (SELECT id, count(*) AS degree FROM z GROUP BY id)"""
_HITS = " + ".join(f"contains(lower(%s), '{t}')::BIGINT" for t in TERMS)
_LOCAL = f"""{_EDGES}, l AS (SELECT id, sum(s)::BIGINT AS score FROM (SELECT id, 2 * ({_HITS.replace('%s', 'id')}) AS s FROM v WHERE ({_HITS.replace('%s', 'id')}) > 0 UNION ALL SELECT id, 1 FROM z WHERE ({_HITS.replace('%s', 'other')}) > 0) GROUP BY id)"""
_GLOBAL = ", w AS (SELECT id, count(*) AS score FROM (SELECT src AS id FROM e WHERE contains(lower(relation), 'aggregates') UNION ALL SELECT dst FROM e WHERE contains(lower(relation), 'aggregates')) GROUP BY id)"
_TYPES = "split_part(id, ':', 1)"
_SCORED = "SELECT id, max(score)::BIGINT AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM w) GROUP BY id"


def _edges(df: DataFrame) -> DataFrame:
    return graph.ledger_edges(df)


def _vertices(df: DataFrame) -> DataFrame:
    ids = graph._ends(graph.canonical(_edges(df))).distinct()
    return ids.withColumn("type", F.upper(F.split_part("id", F.lit(":"), F.lit(1)))).withColumn("importance", F.when(F.length("id") % 2 == 0, F.length("id") / 30))


def _hybrid(df: DataFrame) -> DataFrame:
    edges = _edges(df)
    return questions.local(edges, TERMS).unionByName(questions.global_(edges, ["aggregates"])).groupBy("id").agg(F.max("score").alias("score"))


def _json_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as entities, of which each nation's last counts; relations to nations that no entity names."""
    c = table(spark, sf_dir, "customer")
    entities = c.select(F.concat(F.lit("seg "), "c_mktsegment").alias("id"), F.lit("CATEGORY").alias("type"), F.col("c_name").alias("description"), F.col("c_custkey").alias("position"))
    relations = c.select(F.concat(F.lit("seg "), "c_mktsegment").alias("src"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("LIVES_IN").alias("relation"), (F.col("c_custkey") % 10).cast("double").alias("strength"))
    return graph.from_json(entities, relations)


# -- measures

def _labelled(df: DataFrame) -> DataFrame:
    """Categories by the rules and by the fallback, as two classifiers would give them."""
    return df.select("txn_id", "description", "amount", "date", rules.categorise(F.col("description"), F.col("amount")).alias("category"), refine.fallback_category(F.col("description"), F.col("amount")).alias("other"))


def _classifiers() -> str:
    from ..queries import _cases

    keys = " ".join(f"WHEN contains(low, '{k}') THEN '{v}'" for k, v in rules.KEYWORDS)
    cleaned = "regexp_replace(description, '^\\s+|\\s+$', '', 'g')"
    for p in rules.CLEANING:
        cleaned = f"regexp_replace({cleaned}, '{p}', '', 'g')"
    patterns = " ".join(f"WHEN regexp_matches(lower(regexp_replace({cleaned}, '\\s+', ' ', 'g')), '{p}') THEN '{v}'" for v, p in rules.PATTERNS)
    return f"""{RICH_SQL}, b AS (SELECT *, lower(description) AS low FROM ledger), r AS (SELECT txn_id, CASE WHEN contains(low, 'plan de pensiones') AND amount < 0 THEN 'Savings' WHEN contains(low, 'plan de pensiones') AND amount > 0 THEN 'Income' {keys}
      WHEN amount > 0 AND NOT contains(low, 'devolucion') THEN 'Income' {patterns} ELSE 'Other' END AS category, CASE WHEN amount > 0 THEN 'Income' ELSE {_cases(refine.FALLBACK, "low", "'Other'")} END AS other, CASE WHEN txn_id % 7 = 0 THEN 'Nonsense' END AS given FROM b)"""


def _accuracy(df: DataFrame) -> DataFrame:
    return measures.accuracy(_labelled(df), "other", "category")


def _compared(df: DataFrame) -> DataFrame:
    rows = _labelled(df)
    return measures.compared(rows, rows.select("txn_id", F.col("other").alias("category")))


def _whitelisted(df: DataFrame) -> DataFrame:
    rows = _labelled(df).select("txn_id", F.when(F.col("txn_id") % 7 == 0, "Nonsense").otherwise(F.col("category")).alias("category"))
    name, sure = measures.whitelisted(F.col("category"), F.lit(0.8), F.col("txn_id") % 11 == 0)
    answers = rows.select("txn_id", name.alias("category"), sure.alias("confidence")).where("txn_id % 5 != 0")
    return measures.merged(rows, answers).select("txn_id", "category", "confidence")


def _merged_sql() -> str:
    return """, w AS (SELECT txn_id, coalesce(given, category) AS c FROM r) SELECT txn_id, CASE WHEN txn_id % 5 = 0 THEN c WHEN txn_id % 11 = 0 OR c = 'Nonsense' THEN 'Other' ELSE c END AS category,
      (CASE WHEN txn_id % 5 = 0 THEN 0.0 WHEN txn_id % 11 = 0 THEN 0.2 WHEN c = 'Nonsense' THEN 0.3 ELSE 0.8 END)::DOUBLE AS confidence FROM w"""


def _sources(df: DataFrame) -> DataFrame:
    made = df.groupBy(F.date_format("date", "yyyy-MM").alias("chunk_id")).agg(F.collect_list("txn_id").alias("transaction_ids"))
    return measures.sources(made, df)


def _documents(df: DataFrame) -> DataFrame:
    return measures.documents(chunks.monthly_summaries(df).unionByName(df.limit(0).select(F.lit("x").alias("chunk_id"), F.lit("x").alias("chunk_type"), F.lit("x").alias("key"), F.lit(" ").alias("text")))).select("doc_id", "chunk_type", "key", "chars", "tokens")


def _cache(df: DataFrame) -> DataFrame:
    texts = df.select(F.col("description").alias("text"))
    return measures.to_embed(texts, df.where("description like 'COMPRA%'").select(F.md5("description").alias("key")))


_CHUNKS_MONTHS = "(SELECT * FROM ({months}))"

# -- personal data in bank lines

# A line of each kind; {} is the made-up identifier.
BANK_LINES = ("PAGO DNI {}", "RECIBO NIE {}", "ABONO A LA EMPRESA {}", "CUENTA {}", "BIZUM MOVIL {}", "TARJETA {}", "TPV {}", "SIN DATOS {}")


def bank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and a line with a made-up identifier of the kind id % 8; every third checksum is wrong."""
    p = table(spark, sf_dir, "part")
    key, wrong = F.col("p_partkey"), F.col("p_partkey") % 3 == 0
    eight = F.lpad((key * 7919 % 100_000_000).cast("string"), 8, "0")
    letter = F.substring(F.lit(pii.DNI_LETTERS), ((key * 7919 + F.when(wrong, 1).otherwise(0)) % 23 + 1).cast("int"), F.lit(1))
    account = F.lpad((key * 104_729 + 10**15).cast("string"), 20, "2")
    check = F.lpad((98 - F.concat(account, F.lit("142800")).cast("decimal(30,0)") % 97 + F.when(wrong, 1).otherwise(0)).cast("int").cast("string"), 2, "0")
    phone = F.concat(F.lit("6"), F.lpad((key * 31 % 100).cast("string"), 2, "0"), F.lit(" 22 33 "), F.lpad((key % 100).cast("string"), 2, "0"))
    digits = F.lpad((key * 15_485_863 + 4 * 10**14).cast("string"), 15, "4")
    doubled = sum((F.substring(digits, i, 1).cast("int") * (2 if i % 2 else 1) - F.when((F.substring(digits, i, 1).cast("int") * (2 if i % 2 else 1)) > 9, 9).otherwise(0) for i in range(1, 16)), F.lit(0))
    card = F.concat(digits, ((10 - (doubled + F.when(wrong, 1).otherwise(0)) % 10) % 10).cast("int").cast("string"))
    ids = (F.concat(eight, letter), F.concat(F.lit("X"), F.substring(eight, 1, 7), F.lit("W")), F.concat(F.lit("B"), eight), F.concat(F.lit("ES"), check, account), phone, card, F.concat(F.lit("QWE"), F.substring(eight, 1, 6)), F.lit("ninguno"))
    line = F.coalesce(*(F.when(key % len(BANK_LINES) == i, F.concat(F.lit(t.removesuffix("{}")), v)) for i, (t, v) in enumerate(zip(BANK_LINES, ids, strict=True))))
    return p.select(key.alias("id"), line.alias("line"))


def _bank_sql() -> str:
    doubled = " + ".join(f"(CASE WHEN substr(digits, {i}, 1)::INTEGER * {2 if i % 2 else 1} > 9 THEN substr(digits, {i}, 1)::INTEGER * {2 if i % 2 else 1} - 9 ELSE substr(digits, {i}, 1)::INTEGER * {2 if i % 2 else 1} END)" for i in range(1, 16))
    ids = ("eight || letter", "'X' || substr(eight, 1, 7) || 'W'", "'B' || eight", "'ES' || chk || account", "phone", "card", "'QWE' || substr(eight, 1, 6)", "'ninguno'")
    masks = ("'********X'", "'<ES_NIE>'", "'<ES_CIF>'", "'ES' || chk || '...' || right(account, 4)", "'*** ** ** **'", "'****-****-****-' || right(card, 4)", "'<MERCHANT_CODE>'", "'ninguno'")
    kinds = ("ES_DNI", "ES_NIE", "ES_CIF", "ES_IBAN", "ES_PHONE", "CREDIT_CARD", "MERCHANT_CODE", None)
    bases = {t: c for t, _, c, _ in pii.RECOGNISERS}
    checks = {"ES_DNI", "ES_IBAN", "CREDIT_CARD"}
    # all context words stand within 20 characters of the identifier; BIZUM MOVIL takes the space before its number
    scores = [f"CASE WHEN wrong THEN {max(0, bases[k] + 0.2 + pii.UNCHECKED)} ELSE 1.0 END" if k in checks else str(min(1.0, bases[k] + 0.2)) if k else "0.0" for k in kinds]
    case = lambda xs: "CASE k % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    heads = [f"'{t.removesuffix('{}')}'" for t in BANK_LINES]
    cut = [f"'{t.removesuffix('{}')[: -1 if i == 4 else None]}'" for i, t in enumerate(BANK_LINES)]
    names = ["'" + k + "'" if k else "NULL" for k in kinds]
    return f"""WITH a AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS wrong, lpad((p_partkey * 7919 % 100000000)::VARCHAR, 8, '0') AS eight, lpad((p_partkey * 104729 + 1000000000000000)::VARCHAR, 20, '2') AS account,
      lpad((p_partkey * 15485863 + 400000000000000)::VARCHAR, 15, '4') AS digits, '6' || lpad((p_partkey * 31 % 100)::VARCHAR, 2, '0') || ' 22 33 ' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS phone FROM part),
    b AS (SELECT *, substr('{pii.DNI_LETTERS}', ((k * 7919 + wrong::INTEGER) % 23 + 1)::INTEGER, 1) AS letter, lpad((98 - (account || '142800')::HUGEINT % 97 + wrong::INTEGER)::VARCHAR, 2, '0') AS chk,
      digits || ((10 - ({doubled} + wrong::INTEGER) % 10) % 10)::VARCHAR AS card FROM a),
    bank AS (SELECT k AS id, {case(heads)} || {case(ids)} AS line, {case(cut)} || {case(masks)} AS masked, {case(names)} AS kind, ({case(scores)})::DOUBLE AS confidence, (k % 8 <> 7)::INTEGER AS n FROM b)
    """


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_lines(spark, sf_dir).withColumn("x", pii.analyse(F.col("line")))


def _bank_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("id", "line", F.col("x.masked").alias("masked"), F.get("x.entities", F.lit(0))["kind"].alias("kind"), F.round("x.confidence", 6).alias("confidence"), F.col("x.n").alias("n"))


def _bank_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.statistics(_analysed(spark, sf_dir).select("x.n", "x.confidence"))


def _bank_anonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_lines(spark, sf_dir).select("id", F.col("line").alias("concept"), F.when(F.col("id") % 2 == 0, F.col("line")).alias("notes"))
    out = pii.anonymise(rows)
    return out.select("id", "concept", "notes", "pii_count", F.array_join("pii_kinds", ",").alias("kinds"), "pii_confidence")


def _bank_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _analysed(spark, sf_dir).select(F.inline("x.entities")).select("kind", "text")
    return pii.learn(found).select("kind", F.array_join("patterns", " ").alias("patterns"), "n")


def _certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda sure: F.size(F.filter("x.entities", lambda e: (e["confidence"] >= 0.8) == F.lit(sure)))
    return _analysed(spark, sf_dir).select("id", split(True).alias("certain"), split(False).alias("doubtful"))


_ON_RICH = {
    "qry_aggregation": (questions.aggregation, _AGGREGATION),
    "qry_search": (lambda df: questions.search(df, category="2-HIGH", month=7, least=100.0, weekend=True).select("txn_id", "merchant", "amount"), _SEARCH),
    "qry_search_recurring": (lambda df: questions.search(df, recurring=True).select("txn_id", "merchant", "amount"), _SEARCH_RECURRING),
    "qry_patterns": (questions.patterns, _PATTERNS),
    "qry_savings": (lambda df: questions.savings(df, essential=KEPT), _SAVINGS),
    "qry_trend": (questions.trend, _TREND),
    "qry_local": (lambda df: questions.local(_edges(df), TERMS), f"{_LOCAL} SELECT * FROM l"),
    "qry_global": (lambda df: questions.global_(_edges(df), ["aggregates"]), f"{_EDGES}{_GLOBAL} SELECT * FROM w"),
    "qry_hybrid": (_hybrid, f"{_LOCAL}{_GLOBAL} {_SCORED}"),
    "qry_chunks_used": (lambda df: questions.chunks_used(chunks.entity_chunks(df).unionByName(chunks.category_chunks(df)), _hybrid(df)), f"""{_LOCAL}{_GLOBAL}, h AS ({_SCORED}), k2 AS (SELECT regexp_replace(id, '^[a-z]+:', '') AS key, max(score) AS score FROM h GROUP BY 1),
      m AS (SELECT merchant AS key, 'entity_' || substr(md5(merchant), 1, 8) AS chunk_id FROM ledger WHERE amount <= 0 AND merchant IS NOT NULL GROUP BY merchant HAVING count(*) >= 2 UNION ALL SELECT category, 'category_' || substr(md5(category), 1, 8) FROM ledger WHERE amount <= 0 GROUP BY category HAVING count(*) >= 2)
      SELECT chunk_id, max(score)::BIGINT AS score FROM m JOIN k2 USING (key) GROUP BY chunk_id"""),
    "agg_demo_summary": (questions.demo_summary, _DEMO),
    "agg_income_sources": (measures.income_sources, f"{RICH_SQL} SELECT year, month, category, round(sum(amount), 2) AS income FROM ledger WHERE amount > 0 GROUP BY ALL"),
    "agg_period": (measures.period, f"{RICH_SQL} SELECT min(date) AS first, max(date) AS last, count(*) AS rows FROM ledger"),
    "agg_category_profiles": (chunks.category_profiles, f"""{RICH_SQL}, e AS (SELECT * FROM ledger WHERE amount <= 0), w AS (SELECT category, weekday, round(sum(abs(amount)), 2) AS s FROM e GROUP BY ALL), f AS (SELECT category, list_sort(list(DISTINCT merchant)) AS m FROM e WHERE merchant IS NOT NULL GROUP BY category)
      SELECT g.*, len(m) AS merchants, array_to_string(m[1:5], ', ') AS first_merchants, peak FROM (SELECT category, count(*) AS n, round(sum(abs(amount)), 2) AS spent FROM e GROUP BY category) g JOIN f USING (category) JOIN (SELECT category, arg_max(weekday, (s, -weekday)) AS peak FROM w GROUP BY category) USING (category)"""),
    "agg_category_weekdays": (measures.category_profiles, f"{RICH_SQL} SELECT category, weekday, round(sum(abs(amount)), 2) AS spent, count(*) AS n FROM ledger WHERE amount <= 0 GROUP BY ALL"),
    "agg_week_visits": (lambda df: ops.calendar(df).where("amount < 0 and merchant is not null").groupBy("year", "week", "merchant").agg(F.count("*").alias("visits"), F.round(F.sum(-F.col("amount")), 2).alias("spent")), f"{RICH_SQL} SELECT year, week, merchant, count(*) AS visits, round(sum(-amount), 2) AS spent FROM ledger WHERE amount < 0 AND merchant IS NOT NULL GROUP BY ALL"),
    "agg_model_cost": (lambda df: measures.model_cost(df, "description", 2.0), f"""{RICH_SQL}, s AS (SELECT count(*) AS rows, sum(length(description)) / 4 AS tokens FROM ledger)
      SELECT rows, tokens, round(tokens / 1000 * (0.7::DOUBLE * 0.00005::DOUBLE + (1 - 0.7::DOUBLE) * 0.0004::DOUBLE), 8) AS cost, rows / 2.0::DOUBLE AS per_second, round(tokens / 1000 * (0.7::DOUBLE * 0.00005::DOUBLE + (1 - 0.7::DOUBLE) * 0.0004::DOUBLE) / rows, 10) AS per_row, 90.0::DOUBLE AS saved_percent FROM s"""),
    "win_numbered": (lambda df: measures.numbered(df).select("txn_id", "position", "batch"), f"{RICH_SQL} SELECT txn_id, row_number() OVER (ORDER BY date, txn_id) - 1 AS position, (row_number() OVER (ORDER BY date, txn_id) - 1) // 20 AS batch FROM ledger"),
    "flt_chronology": (measures.out_of_order, f"{RICH_SQL}, l AS (SELECT lag(date) OVER (ORDER BY txn_id) > date AS bad FROM ledger) SELECT count(*) FILTER (bad) AS out_of_order FROM l"),
    "prj_date_names": (measures.date_names, f"{RICH_SQL} SELECT txn_id, strftime(date, '%A') AS weekday, strftime(date, '%B %Y') AS month, strftime(date, '%B %d, %Y') AS long_date FROM ledger"),
    "prj_direct_amounts": (lambda df: df.select("txn_id", measures.direct_amount(F.concat(F.regexp_replace(F.format_string("%.2f", "amount"), r"\.", ","), F.lit(" EUR"))).alias("amount")), f"{RICH_SQL} SELECT txn_id, amount FROM ledger"),
    "jon_chunk_sources": (_sources, f"{RICH_SQL} SELECT strftime(date, '%Y-%m') AS chunk_id, count(*) AS transactions, round(sum(amount), 2) AS total FROM ledger GROUP BY 1"),
    "emb_cache": (_cache, f"{RICH_SQL} SELECT DISTINCT md5(description) AS key, description AS text FROM ledger WHERE description NOT LIKE 'COMPRA%'"),
    "gra_labels": (lambda df: graph.label_counts(_edges(df)), f"{_EDGES} SELECT relation, count(*) AS n FROM e GROUP BY relation ORDER BY n DESC, relation LIMIT 10"),
    "gra_top_degrees": (lambda df: graph.top_degrees(_edges(df)), f"{_EDGES} SELECT * FROM v ORDER BY degree DESC, id LIMIT 10"),
    "gra_types": (lambda df: graph.type_counts(_vertices(df)), f"{_EDGES} SELECT upper({_TYPES}) AS type, count(*) AS n, array_to_string(list_sort(list(id))[1:10], ', ') AS first FROM v GROUP BY 1"),
    "gra_average_clustering": (lambda df: graph.average_clustering(_edges(df)), f"""{_EDGES}, k3 AS (SELECT x.id, count(*) AS t FROM z x JOIN z y ON x.id = y.id AND x.other < y.other JOIN p ON p.a = x.other AND p.b = y.other GROUP BY x.id)
      SELECT round(avg(CASE WHEN degree > 1 THEN round(2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)), 8) ELSE 0 END), 6) AS clustering FROM v LEFT JOIN k3 USING (id)"""),
    "gra_insights": (lambda df: graph.insights(_edges(df)), f"{_EDGES}, s2 AS (SELECT count(*) AS n, sum(degree) / 2 AS m, count(*) FILTER (degree > 5) AS hubs FROM v) SELECT CASE WHEN 2.0 * m / (n * (n - 1)) < 0.1 THEN 'sparse' WHEN 2.0 * m / (n * (n - 1)) > 0.3 THEN 'dense' ELSE 'even' END AS kind, hubs FROM s2"),
    "gra_styles": (lambda df: graph.styled(_vertices(df)), f"""{_EDGES}, i AS (SELECT id, upper({_TYPES}) AS type, coalesce(CASE WHEN length(id) % 2 = 0 THEN length(id) / 30 END, 0.5) AS w FROM v)
      SELECT id, CASE WHEN length(id) > 20 THEN substr(id, 1, 17) || '...' ELSE id END AS label, CASE type {' '.join(f"WHEN '{t}' THEN '{c}'" for t, c in graph.COLOURS.items())} ELSE '{graph.COLOURS['default']}' END AS colour,
      round(CASE type {' '.join(f"WHEN '{t}' THEN {c}" for t, c in graph.SIZES.items())} ELSE 20 END * (0.5 + w), 4)::DOUBLE AS size, CASE WHEN type = 'CHUNK' THEN 'square' ELSE 'dot' END AS shape, CASE WHEN w > 0.7 THEN 3 ELSE 2 END AS border FROM i"""),
    "gra_named_amounts": (lambda df: graph.named_amounts(df.select(F.concat(F.lit("Pago €"), F.format_number(F.abs("amount"), 2)).alias("id")).distinct()), f"{RICH_SQL} SELECT DISTINCT 'Pago €' || format('{{:,.2f}}', abs(amount)) AS id, abs(amount) AS amount FROM ledger ORDER BY amount DESC, id LIMIT 10"),
    "gra_chunk_statistics": (lambda df: graph.chunk_statistics(chunks.monthly_summaries(df), _edges(df)), f"{_EDGES}, c4 AS (SELECT count(DISTINCT (year, month)) AS chunk_nodes FROM ledger), s4 AS (SELECT count(*) AS other_nodes, (sum(degree) // 2)::BIGINT AS edges FROM v) SELECT *, chunk_nodes + other_nodes AS nodes FROM c4, s4"),
    "cls_unresolved": (lambda df: measures.unresolved(_labelled(df)).select("txn_id"), lambda: f"{_classifiers()} SELECT txn_id FROM r WHERE category = 'Other'"),
    "cls_whitelisted": (_whitelisted, lambda: _classifiers() + _merged_sql()),
    "agg_accuracy": (_accuracy, lambda: f"{_classifiers()}, q AS (SELECT round(100.0 * avg((other <> 'Other')::INTEGER), 4) AS before, round(100.0 * avg((category <> 'Other')::INTEGER), 4) AS after FROM r) SELECT *, round(after - before, 4) AS improvement FROM q"),
    "agg_category_change": (lambda df: measures.category_change(_labelled(df), "other", "category"), lambda: f"{_classifiers()}, u AS (SELECT category, 1 AS n, 0 AS b FROM r UNION ALL SELECT other, 0, 1 FROM r) SELECT category, sum(n)::BIGINT AS n, round(100.0 * sum(n) / (SELECT count(*) FROM r), 4) AS percent, (sum(n) - sum(b))::BIGINT AS delta FROM u GROUP BY category"),
    "jon_compared": (_compared, lambda: f"{_classifiers()} SELECT count(*) AS rows, count(*) FILTER (category = other) AS agree, round(100.0 * count(*) FILTER (category = other) / count(*), 4) AS percent FROM r"),
    "agg_outcomes": (lambda df: measures.outcomes(_labelled(df).withColumn("method", F.when(F.col("category") == F.col("other"), "memory").otherwise("research"))), lambda: f"{_classifiers()} SELECT CASE WHEN category = other THEN 'memory' ELSE 'research' END AS method, count(*) AS n FROM r GROUP BY 1"),
    "prj_rag_records": (lambda df: _rag(_labelled(df)), lambda: f"{_classifiers()} SELECT r.txn_id, strftime(date, '%Y-%m-%d') AS fecha, abs(amount) AS importe, CASE WHEN amount < 0 THEN 'gasto' ELSE 'ingreso' END AS tipo, CASE r.category {_spanish()} ELSE 'otros' END AS categoria FROM r JOIN ledger USING (txn_id) WHERE r.category <> 'Internal Transfer'"),
}


def _rag(df: DataFrame) -> DataFrame:
    return refine.rag_records(df)


def _spanish() -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in refine.SPANISH.items())


def _documents_sql() -> str:
    return f"SELECT chunk_id AS doc_id, chunk_type, key, length(text)::INTEGER AS chars, ceil(length(text) / 4)::INTEGER AS tokens FROM ({_monthly()})"


def _context_sql() -> str:
    return f"SELECT chunk_id, 'Tipo: ' || chunk_type || chr(10) || 'Clave: ' || key || chr(10) || 'Contenido: ' || text AS context FROM ({_monthly()})"


def _previews_sql() -> str:
    return f"SELECT 'chunk:' || chunk_id AS id, 'chunk' AS type, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM ({_monthly()})"


_ON_RICH |= {
    "emb_documents": (_documents, _documents_sql),
    "emb_context": (lambda df: measures.context_text(chunks.monthly_summaries(df)), _context_sql),
    "gra_chunk_vertices": (lambda df: graph.chunk_vertices(chunks.monthly_summaries(df)), _previews_sql),
}
_SEGMENTS = "WITH e AS (SELECT 'seg ' || c_mktsegment AS id, c_name, c_custkey FROM customer), "

QUERIES = {name: lambda spark, sf_dir, f=f: f(rich_ledger(spark, sf_dir)) for name, (f, _) in _ON_RICH.items()} | {
    "qry_intents": _routed,
    "pii_bank_lines": _bank_entities,
    "pii_statistics": _bank_statistics,
    "pii_anonymised": _bank_anonymised,
    "pii_learned": _bank_learned,
    "pii_certain": _certain,
    "gra_vertices": lambda spark, sf_dir: _json_graph(spark, sf_dir)[0],
    "gra_relations": lambda spark, sf_dir: _json_graph(spark, sf_dir)[1],
    "gra_communities": lambda spark, sf_dir: graph.communities(_edges(rich_ledger(spark, sf_dir)), 2),
}


def oracles() -> dict[str, str]:
    out = {name: sql if isinstance(sql, str) else sql() for name, (_, sql) in _ON_RICH.items()}
    sql = _bank_sql()
    return out | {
        "qry_intents": _routed_sql(),
        "pii_bank_lines": f"{sql} SELECT id, line, masked, kind, round(confidence, 6) AS confidence, n FROM bank",
        "pii_statistics": f"{sql} SELECT count(*) AS texts, round(avg(confidence), 3) AS mean_confidence, round(avg(n), 1) AS mean_entities, count(*) FILTER (confidence < 0.5) AS uncertain FROM bank",
        "pii_anonymised": f"{sql} SELECT id, masked AS concept, CASE WHEN id % 2 = 0 THEN masked END AS notes, CASE WHEN id % 2 = 0 THEN 2 * n ELSE n END AS pii_count, coalesce(kind, '') AS kinds, round(confidence, 6) AS pii_confidence FROM bank",
        "pii_certain": f"{sql} SELECT id, (n = 1 AND confidence >= 0.8)::INTEGER AS certain, (n = 1 AND confidence < 0.8)::INTEGER AS doubtful FROM bank",
        "pii_learned": f"""{sql}, t AS (SELECT kind, replace(line, split_part(line, ' ', 1) || ' ', '') AS x FROM bank WHERE kind IN ('ES_IBAN', 'MERCHANT_CODE')),
          s AS (SELECT DISTINCT kind, regexp_replace(regexp_replace(regexp_replace(x, '\\d', '\\\\d', 'g'), '[A-Z]', '[A-Z]', 'g'), '[a-z]', '[a-z]', 'g') AS p FROM t WHERE length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2) SELECT kind, string_agg(p, ' ' ORDER BY p) AS patterns, count(*) AS n FROM s GROUP BY kind""",
        "gra_vertices": _SEGMENTS + "n AS (SELECT id, 'CATEGORY' AS type, arg_max(c_name, c_custkey) AS description FROM e GROUP BY id) SELECT * FROM n UNION ALL SELECT DISTINCT 'nation ' || c_nationkey::VARCHAR, 'default', '' FROM customer",
        "gra_relations": "SELECT 'nation ' || c_nationkey::VARCHAR AS src, 'seg ' || c_mktsegment AS dst, 'LIVES_IN' AS relation, max(c_custkey % 10)::DOUBLE AS strength FROM customer GROUP BY 1, 2",
    }
