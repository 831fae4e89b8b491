"""Registered queries of the ledger engine over the test tables, and their DuckDB SQL.

The ledger is made of orders: the order's day is the date, open orders are expenses and the others income, the
customer is the merchant and the priority the category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pii, rules
from .operators import graph, refine
from .operators import ledger as ops
from .plans import answers
from .plans import chunks as chunk_plans
from .plans.chunks import TEXTS

FLAGSHIP = "agg_monthly"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    amount = F.when(F.col("o_orderstatus") == "O", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("txn_id"), F.to_date("o_orderdate").alias("date"), amount.alias("amount"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("merchant"), F.col("o_orderpriority").alias("category"))


LEDGER_SQL = """WITH ledger AS (SELECT o_orderkey AS txn_id, o_orderdate::DATE AS date,
  CASE WHEN o_orderstatus = 'O' THEN -o_totalprice ELSE o_totalprice END AS amount,
  'm' || o_custkey::VARCHAR AS merchant, o_orderpriority AS category,
  (isodow(o_orderdate::DATE) - 1)::INTEGER AS weekday, month(o_orderdate)::INTEGER AS month,
  year(o_orderdate)::INTEGER AS year, week(o_orderdate)::INTEGER AS week FROM orders)
"""
TOTALS = """count(*) AS n, round(coalesce(sum(amount) FILTER (amount > 0), 0), 2) AS income,
  round(coalesce(sum(-amount) FILTER (amount < 0), 0), 2) AS expenses, round(coalesce(sum(amount), 0), 2) AS net"""

#: Descriptions to classify are TEXTS, chosen by a part's key, and its brand.
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat(F.get(F.array(*(F.lit(t) for t in TEXTS)), (F.col("p_partkey") % len(TEXTS)).cast("int")), F.lit(" "), F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), text.alias("description"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).otherwise(-F.col("p_retailprice")).alias("amount"))


def _on_ledger(f):
    return lambda spark, sf_dir: f(ledger(spark, sf_dir))


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptions(spark, sf_dir).select("id", rules.clean_description(F.col("description")).alias("cleaned"), rules.categorise(F.col("description"), F.col("amount")).alias("category"))


def _merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptions(spark, sf_dir).select("id", rules.merchant(F.col("description")).alias("merchant"))


def _categories_sql() -> str:
    texts = ", ".join(f"'{t}'" for t in TEXTS)
    cleaned = "regexp_replace(description, '^\\s+|\\s+$', '', 'g')"
    for p in rules.CLEANING:
        cleaned = f"regexp_replace({cleaned}, '{p}', '', 'g')"
    cleaned = f"regexp_replace({cleaned}, '\\s+', ' ', 'g')"
    keys = " ".join(f"WHEN contains(low, '{k}') THEN '{v}'" for k, v in rules.KEYWORDS)
    patterns = " ".join(f"WHEN regexp_matches(lower(cleaned), '{p}') THEN '{v}'" for v, p in rules.PATTERNS)
    return f"""WITH d AS (SELECT p_partkey AS id, ([{texts}])[(p_partkey % {len(TEXTS)})::INTEGER + 1] || ' ' || p_brand AS description,
  CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE -p_retailprice END AS amount FROM part),
c AS (SELECT id, amount, lower(description) AS low, {cleaned} AS cleaned FROM d)
SELECT id, cleaned, CASE WHEN contains(low, 'plan de pensiones') AND amount < 0 THEN 'Savings'
  WHEN contains(low, 'plan de pensiones') AND amount > 0 THEN 'Income' {keys}
  WHEN amount > 0 AND NOT contains(low, 'devolucion') THEN 'Income' {patterns} ELSE 'Other' END AS category FROM c"""


def _merchants_sql() -> str:
    known = " ".join(f"WHEN contains(low, '{k}') THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in rules.MERCHANTS)
    title = lambda w: f"upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"
    return f"""WITH d AS (SELECT p_partkey AS id, ([{', '.join(f"'{t}'" for t in TEXTS)}])[(p_partkey % {len(TEXTS)})::INTEGER + 1] || ' ' || p_brand AS description FROM part),
w AS (SELECT id, lower(description) AS low, string_split(description, ' ') AS w FROM d),
f AS (SELECT *, list_filter(w[3:], lambda x: length(x) > 3 AND lower(x) <> 'tarjeta')[1] AS card, list_filter(w, lambda x: length(x) > 3 AND lower(x) NOT IN ('pago', 'con', 'tarjeta', 'compra'))[1] AS first FROM w)
SELECT id, CASE {known} WHEN (contains(low, 'pago con tarjeta') OR contains(low, 'compra tarjeta')) AND card IS NOT NULL THEN {title('card')} WHEN contains(low, 'transferencia') THEN 'Transfer' WHEN first IS NOT NULL THEN {title('first')} ELSE 'Unknown' END AS merchant FROM f"""


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", pii.analyse(F.col("text")).alias("x"))
    return d.select("doc_id", F.col("x.n").cast("bigint").alias("entities"), F.md5("x.masked").alias("masked_md5"))


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    query = e.where("vec_id = 0").select("embedding").first()[0]
    return ops.cosine_topk(e, query)


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return ops.degrees(line.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")))


def _spanish_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    shown = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return o.select("o_orderkey", rules.spanish_decimal(shown).alias("amount"))


def _event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with their fallback category and a made-up confidence, as a model would give them."""
    d = descriptions(spark, sf_dir)
    return d.select("id", F.col("description"), "amount", F.col("description").alias("merchant"), refine.fallback_category(F.col("description"), F.col("amount")).alias("category"), (F.lit(0.5) + F.col("id") % 50 / 100).alias("confidence"))


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir).select("id", "category", refine.spanish_category(F.col("category")).alias("categoria"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.validate(_refined(spark, sf_dir)).select("id", "category", F.round("confidence", 6).alias("confidence"), "adjustments")


def _validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.validity(_refined(spark, sf_dir))


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    seen = o.select(F.concat(F.lit(" M"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), F.col("o_orderdate").alias("last_updated"))
    return refine.upsert_memory(None, seen).select("key", "category", "confidence", "frequency")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations and regions as a graph."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")).unionByName(n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))


def _node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = descriptions(spark, sf_dir)
    return d.select("id", graph.node_type(F.col("description")).alias("node_type"), graph.entity_type(F.col("description"), F.lit("person")).alias("entity_type"))


def _cases(table: tuple, column: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{v}'" for v, p in table) + f" ELSE {otherwise} END"


def _refined_sql() -> str:
    texts = ", ".join(f"'{t}'" for t in TEXTS)
    return f"""WITH d AS (SELECT p_partkey AS id, ([{texts}])[(p_partkey % {len(TEXTS)})::INTEGER + 1] || ' ' || p_brand AS description,
  CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE -p_retailprice END AS amount FROM part),
r AS (SELECT id, description, amount, lower(description) AS low, CASE WHEN amount > 0 THEN 'Income' ELSE {_cases(refine.FALLBACK, "lower(description)", "'Other'")} END AS category, 0.5::DOUBLE + (id % 50) / 100.0::DOUBLE AS confidence FROM d)
"""


GRAPH_SQL = """, t AS (SELECT DISTINCT 'merchant:' || merchant AS m, 'category:' || category AS c, 'weekday:' || weekday::VARCHAR AS d FROM ledger),
  e AS (SELECT m AS x, c AS y FROM t UNION SELECT m, d FROM t UNION SELECT c, d FROM t),
  p AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM e), z AS (SELECT a AS id, b AS other FROM p UNION ALL SELECT b, a FROM p),
  g AS (SELECT id, count(*) AS degree FROM z GROUP BY id)
"""


_SPENT = LEDGER_SQL + "SELECT "
_PAIRS = {
    "agg_statistics": (ops.statistics, f"SELECT {TOTALS}, round(coalesce(avg(-amount) FILTER (amount < 0), 0), 2) AS mean_expense, round(coalesce(max(-amount) FILTER (amount < 0), 0), 2) AS max_expense, round(coalesce(max(amount) FILTER (amount > 0), 0), 2) AS max_income FROM ledger"),
    "agg_expense_by_category": (ops.expense_by_category, "SELECT category, round(sum(-amount), 2) AS spent FROM ledger WHERE amount < 0 GROUP BY category"),
    "agg_category_shares": (ops.category_shares, "SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM ledger GROUP BY category"),
    "agg_merchant_profiles": (ops.merchant_profiles, """, g AS (SELECT merchant, count(*) AS n, round(sum(-amount), 2) AS spent, min(date) AS first, max(date) AS last, count(DISTINCT category) AS categories, round(arg_max(-amount, (date, txn_id)), 2) AS last_amount, round(avg(-amount), 6) AS mean FROM ledger WHERE amount < 0 GROUP BY merchant HAVING count(*) >= 2)
      SELECT *, CASE WHEN last_amount > 1.2 * mean THEN 'rising' WHEN last_amount < 0.8 * mean THEN 'falling' ELSE 'stable' END AS trend FROM g"""),
    "agg_weekday_spend": (ops.weekday_spend, "SELECT weekday, count(*) AS n, round(sum(-amount), 2) AS spent FROM ledger WHERE amount < 0 GROUP BY weekday"),
    "agg_daily": (ops.daily, f"SELECT date, {TOTALS} FROM ledger GROUP BY date HAVING count(*) >= 2"),
    "agg_weekly": (ops.weekly, f'SELECT year, week, {TOTALS}, min(date) AS start, max(date) AS "end" FROM ledger GROUP BY year, week HAVING count(*) >= 4'),
    "agg_monthly": (ops.monthly, f""", g AS (SELECT year, month, {TOTALS}, count(DISTINCT merchant) AS merchants FROM ledger GROUP BY year, month)
      SELECT *, CASE WHEN income > 1.1 * expenses THEN 'surplus' WHEN income > expenses THEN 'balanced' ELSE 'deficit' END AS health, round(expenses / 30, 2) AS avg_daily FROM g"""),
    "agg_month_distribution": (ops.month_distribution, """, g AS (SELECT year, month, category, sum(-amount) AS s FROM ledger WHERE amount < 0 GROUP BY ALL)
      SELECT year, month, category, round(s, 2) AS spent, round(100.0 * s / sum(s) OVER (PARTITION BY year, month), 4) AS percent, (row_number() OVER (PARTITION BY year, month ORDER BY s DESC, category))::INTEGER AS rank FROM g"""),
    "agg_peak_weekday": (ops.peak_weekday, ", g AS (SELECT category, weekday, round(sum(-amount), 2) AS s FROM ledger WHERE amount < 0 GROUP BY ALL) SELECT category, arg_max(weekday, (s, -weekday)) AS peak_weekday FROM g GROUP BY category"),
    "agg_heaviest_day": (ops.heaviest_day, ", g AS (SELECT year, month, date, round(sum(amount), 2) AS s FROM ledger WHERE amount < 0 GROUP BY ALL) SELECT year, month, arg_min(date, (s, date)) AS day, -min(s) AS spent FROM g GROUP BY year, month"),
    "win_running_balance": (ops.running_balance, ", g AS (SELECT date, sum(amount) AS s FROM ledger GROUP BY date) SELECT date, round(sum(s) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 2) AS balance FROM g"),
    "win_visits": (ops.visits, "SELECT txn_id, merchant, (row_number() OVER w)::INTEGER AS visit, date_diff('day', lag(date) OVER w, date)::INTEGER AS days_since FROM ledger WINDOW w AS (PARTITION BY merchant ORDER BY date, txn_id)"),
    "win_running_category": (ops.running_category, "SELECT txn_id, month, category, round(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) OVER (PARTITION BY month, category ORDER BY date, txn_id ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM ledger"),
    "win_recurrence": (ops.recurrence, """, g AS (SELECT merchant, date_diff('day', lag(date) OVER (PARTITION BY merchant ORDER BY date, txn_id), date) AS d FROM ledger WHERE amount < 0),
      h AS (SELECT merchant, count(*) AS intervals, round(avg((d BETWEEN 28 AND 32)::INTEGER), 6) AS monthly, round(avg((d BETWEEN 6 AND 8)::INTEGER), 6) AS weekly FROM g WHERE d IS NOT NULL GROUP BY merchant)
      SELECT *, CASE WHEN weekly >= 0.6 THEN 'weekly' WHEN monthly >= 0.6 THEN 'monthly' ELSE 'none' END AS kind FROM h"""),
    "win_week_change": (ops.week_change, """, g AS (SELECT year, week, round(coalesce(sum(-amount) FILTER (amount < 0), 0), 2) AS expenses FROM ledger GROUP BY year, week), h AS (SELECT *, lag(expenses) OVER (ORDER BY year, week) AS before FROM g)
      SELECT *, CASE WHEN expenses > 1.2 * before THEN 'up' WHEN expenses < 0.8 * before THEN 'down' WHEN before IS NOT NULL THEN 'steady' END AS band FROM h"""),
    "top_merchants_by_week": (ops.top_merchants_by_week, ", g AS (SELECT year, week, merchant, round(sum(-amount), 2) AS spent FROM ledger WHERE amount < 0 GROUP BY ALL), h AS (SELECT *, (row_number() OVER (PARTITION BY year, week ORDER BY spent DESC, merchant))::INTEGER AS rank FROM g) SELECT * FROM h WHERE rank <= 3"),
    "prj_identifiers": (ops.identifiers, "SELECT txn_id, substr(md5(strftime(date, '%Y-%m-%d') || '|' || merchant || '|' || txn_id::VARCHAR), 1, 12) AS chunk_id, printf('weekly_%d_w%02d', year, week) AS week_id, strftime(date, '%d/%m/%Y') AS shown FROM ledger"),
    "cls_amount_bands": (ops.amount_bands, ", g AS (SELECT *, round_even(sum(round(abs(amount) * 100)::BIGINT) OVER (PARTITION BY merchant)::DOUBLE / count(amount) OVER (PARTITION BY merchant), 0) / 100 AS typical FROM ledger) SELECT txn_id, typical, CASE WHEN abs(amount) > 1.5 * typical THEN 'high' WHEN abs(amount) < 0.5 * typical THEN 'low' ELSE 'typical' END AS band, day(date) >= 25 AS month_end FROM g"),
    "prj_calendar": (lambda df: ops.calendar(df).select("txn_id", "weekday", "month", "year", "week", "is_weekend", "is_income"), "SELECT txn_id, weekday, month, year, week, weekday >= 5 AS is_weekend, amount > 0 AS is_income FROM ledger"),
    "prj_compact_lines": (lambda df: df.select("txn_id", refine.compact_line(F.col("txn_id"), F.col("date"), F.col("merchant"), F.col("amount")).alias("line")), "SELECT txn_id, concat_ws('|', txn_id::VARCHAR, strftime(date, '%Y-%m-%d'), merchant, CASE WHEN amount > 0 THEN '+' ELSE '-' END || printf('€%.2f', abs(amount))) AS line FROM ledger"),
    "emb_prepared": (lambda df: df.select("txn_id", refine.embedding_text(F.lit("categorical"), F.col("merchant"), F.col("category"), F.lit("")).alias("text")), "SELECT txn_id, '[' || category || '] ' || merchant AS text FROM ledger"),
    "agg_embedding_cost": (lambda df: refine.embedding_cost(df, "merchant"), "SELECT count(*) AS chunks, sum(length(merchant))::BIGINT AS chars, sum(length(merchant)) / 4.0 AS tokens, round(sum(length(merchant)) / 4.0 / 1000 * 0.00002::DOUBLE, 8) AS cost FROM ledger"),
    "gra_summary": (lambda df: graph.summary(graph.ledger_edges(df)), GRAPH_SQL + ", s AS (SELECT count(*) AS n, sum(degree)::BIGINT // 2 AS m FROM g) SELECT n, m, round(2.0::DOUBLE * m / (n * (n - 1)), 8) AS density FROM s"),
    "gra_clustering": (lambda df: graph.clustering(graph.ledger_edges(df)), GRAPH_SQL + """, k AS (SELECT x.id, count(*) AS t FROM z x JOIN z y ON x.id = y.id AND x.other < y.other JOIN p ON p.a = x.other AND p.b = y.other GROUP BY x.id)
      SELECT id, degree, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN round(2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)), 8) ELSE 0 END AS coefficient FROM g LEFT JOIN k USING (id)"""),
    "gra_neighbours": (lambda df: graph.neighbours(graph.ledger_edges(df)), GRAPH_SQL + "SELECT id, count(*) AS degree, array_to_string(list_slice(list_sort(list(other)), 1, 3), ', ') AS first FROM z GROUP BY id"),
}

QUERIES = {name: _on_ledger(f) for name, (f, _) in _PAIRS.items()} | chunk_plans.QUERIES | answers.QUERIES | {
    "cls_categories": _categories,
    "cls_merchants": _merchants,
    "pii_masked_documents": _masked,
    "vec_cosine_topk": _cosine,
    "gra_degrees": _degrees,
    "prj_spanish_amounts": _spanish_amounts,
    "agg_event_windows": _event_windows,
    "cls_fallback": _fallback,
    "cls_validated": _validated,
    "flt_validity": _validity,
    "mem_upsert": _memory,
    "gra_components": lambda spark, sf_dir: graph.components(_places(spark, sf_dir)),
    "cls_node_types": _node_types,
}

ORACLES = {name: LEDGER_SQL + sql for name, (_, sql) in _PAIRS.items() if sql} | chunk_plans.ORACLES | answers.oracles() | {
    "cls_categories": _categories_sql(),
    "cls_merchants": _merchants_sql(),
    "vec_cosine_topk": """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
      s AS (SELECT vec_id, list_sum(list_transform(generate_series(1, len(e)), lambda i: embedding[i]::DOUBLE * e[i]::DOUBLE)) AS d,
        list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS a, list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE)) AS b FROM embeddings, q)
      SELECT vec_id, round(d / sqrt(a * b), 6) AS score FROM s ORDER BY d / sqrt(a * b) DESC, vec_id LIMIT 10""",
    "gra_degrees": "WITH e AS (SELECT DISTINCT 'p' || l_partkey::VARCHAR AS src, 's' || l_suppkey::VARCHAR AS dst FROM lineitem), b AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) SELECT id, count(*) AS degree FROM b GROUP BY id",
    "prj_spanish_amounts": "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders",
    "agg_event_windows": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "cls_fallback": _refined_sql() + "SELECT id, category, CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in refine.SPANISH.items()) + " ELSE 'otros' END AS categoria FROM r",
    "cls_validated": _refined_sql() + """, v AS (SELECT *, contains(low, 'traspaso') AND category <> 'Internal Transfer' AS inner_move, category = 'Income' AND amount < 0 AS w1, category IN ('Savings', 'Taxes', 'Loan') AND amount > 0 AS w2 FROM r)
      SELECT id, CASE WHEN inner_move THEN 'Internal Transfer' ELSE category END AS category, round(least(CASE WHEN inner_move THEN 0.9 ELSE confidence * CASE WHEN w1 THEN 0.7 ELSE 1 END * CASE WHEN w2 THEN 0.8 ELSE 1 END END, 0.95)::DOUBLE, 6) AS confidence,
        concat_ws('; ', CASE WHEN w1 THEN 'Income usually positive' END, CASE WHEN w2 THEN category || ' usually negative' END, CASE WHEN inner_move THEN 'Detected as internal transfer' END) AS adjustments FROM v""",
    "flt_validity": _refined_sql() + "SELECT count(*) AS n, count(*) > 0 AS is_valid, count(*) FILTER (category = 'Other') AS uncategorised, round(100.0 * count(*) FILTER (category = 'Other') / count(*), 4) AS percent, count(*) FILTER (category = 'Other') > 0.3 * count(*) AS warn FROM r",
    "mem_upsert": """WITH s AS (SELECT 'm' || o_custkey::VARCHAR AS key, o_orderpriority AS category, (o_orderkey % 100) / 100.0::DOUBLE AS confidence, o_orderdate AS seen FROM orders)
      SELECT key, arg_max(category, (seen, category, confidence)) AS category, arg_max(confidence, (seen, category, confidence)) AS confidence, count(*) AS frequency FROM s WHERE confidence > 0.6 GROUP BY key""",
    "gra_components": """WITH v AS (SELECT 'c' || c_custkey::VARCHAR AS id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey::VARCHAR, n_regionkey FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey::VARCHAR, n_regionkey FROM nation)
      SELECT id, min(id) OVER (PARTITION BY r) AS component FROM v""",
    "cls_node_types": _refined_sql() + f"SELECT id, {_cases(graph.NODE_WORDS, 'low', chr(39) + 'otros' + chr(39))} AS node_type, {_cases(graph.ENTITY_WORDS, 'low', chr(39) + 'PERSON' + chr(39))} AS entity_type FROM r",
}
