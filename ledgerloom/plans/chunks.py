"""Queries of the chunk builders and of what needs a ledger with outliers, notes and recurring payments, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks
from ..operators import ledger as ops

# Statement texts of the fixture.
TEXTS = ("COMPRA EN MERCADONA", "PAGO CON TARJETA EN ZARA MADRID", "NOMINA JULIO", "TRASPASO CUENTA", "RECIBO DE LUZ ENDESA", "TRANSFERENCIA DE PEPE", "BAR LA PLAZA", "PLAN DE PENSIONES", "CAJERO 1234567890123", "DEVOLUCION AMAZON", "GITHUB SUBSCRIPTION", "TAXI ****1234")


def rich_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger: some amounts are 20 times as large, some merchants unknown, some pay every 30 days."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    size = F.floor(F.col("o_totalprice") / 10).cast("double") / 100 * F.when(key % 97 == 0, 20.0).otherwise(1.0)
    text = F.get(F.array(*map(F.lit, TEXTS)), (key % len(TEXTS)).cast("int"))
    notes = F.when(key % 5 == 0, F.concat(text, F.lit(" seen again by customer "), customer.cast("string"))).when(key % 7 == 0, F.lit("short"))
    paid = F.to_date(F.lit("1995-01-15"))
    return o.select(
        key.alias("txn_id"), F.when(customer % 10 == 0, F.date_add(paid, (30 * (key % 12)).cast("int"))).otherwise(F.to_date("o_orderdate")).alias("date"),
        F.round(F.when(F.col("o_orderstatus") == "O", -size).otherwise(size) * F.when((customer % 10 == 0), F.lit(-1.0)).otherwise(1.0), 2).alias("amount"),
        F.when(customer % 31 != 0, F.concat(F.lit("m"), customer.cast("string"))).alias("merchant"), F.col("o_orderpriority").alias("category"), text.alias("description"),
        F.when(key % 3 != 0, F.floor(F.col("o_totalprice") / 40).cast("double")).alias("balance"), notes.alias("notes"),
    )


RICH_SQL = f"""WITH base AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice / 10)::DOUBLE / 100 * CASE WHEN o_orderkey % 97 = 0 THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END AS size,
  ([{', '.join(f"'{t}'" for t in TEXTS)}])[(o_orderkey % {len(TEXTS)})::INTEGER + 1] AS t, * FROM orders),
rows AS (SELECT k AS txn_id, CASE WHEN c % 10 = 0 THEN DATE '1995-01-15' + (30 * (k % 12))::INTEGER ELSE o_orderdate::DATE END AS date,
  round(CASE WHEN o_orderstatus = 'O' THEN -size ELSE size END * CASE WHEN c % 10 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END, 2) AS amount,
  CASE WHEN c % 31 <> 0 THEN 'm' || c::VARCHAR END AS merchant, o_orderpriority AS category, t AS description, CASE WHEN k % 3 <> 0 THEN floor(o_totalprice / 40)::DOUBLE END AS balance,
  CASE WHEN k % 5 = 0 THEN t || ' seen again by customer ' || c::VARCHAR WHEN k % 7 = 0 THEN 'short' END AS notes FROM base),
ledger AS (SELECT *, (isodow(date) - 1)::INTEGER AS weekday, month(date)::INTEGER AS month, year(date)::INTEGER AS year, week(date)::INTEGER AS week FROM rows)
"""
TOTALS = """count(*) AS n, round(coalesce(sum(amount) FILTER (amount > 0), 0), 2) AS income,
  round(coalesce(sum(-amount) FILTER (amount < 0), 0), 2) AS expenses"""


def say(phrase: str, *values: str) -> str:
    head, *rest = (x.replace("'", "''") for x in chunks.PHRASES[phrase].split("{}"))
    return f"('{head}'" + "".join(f" || ({v})::VARCHAR || '{t}'" for v, t in zip(values, rest, strict=True)) + ")"


def when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} END"


def told(*parts: str) -> str:
    return f"concat_ws(' ', {', '.join(parts)})"


def euros(x: str) -> str:
    return f"printf('%.2f', round_even({x}, 2))"


def _id(kind: str, key: str, n: int) -> str:
    return f"'{kind}_' || substr(md5({key}), 1, {n})"


def _listing(keys: str, name: str, item: str, sep: str = " ") -> str:
    return f"string_agg({item}, '{sep}' ORDER BY s DESC, {name})"


NET = "round(income - expenses, 2)"
_MERCHANT = "merchant IS NOT NULL AND merchant <> ''"


def _narratives() -> str:
    payee = when(_MERCHANT, told(say("paid", "merchant"), f"CASE WHEN abs(amount) > mean * 1.5 THEN {say('higher', euros('mean'))} WHEN abs(amount) < mean * 0.5 THEN {say('lower', euros('mean'))} ELSE {say('typical')} END", when("visits > 1", say("visit", "visit", "merchant"))))
    income = told(say("income", euros("amount")), f"coalesce({when('contains(lower(description), ' + chr(39) + 'pension' + chr(39) + ')', say('pension'))}, {when(_MERCHANT, say('received', 'merchant'))}, {say('described', 'description')})", say("income_category", "category"))
    expense = told(say("expense", euros("abs(amount)")), f"coalesce({payee}, {say('bought', 'description')})", say("expense_category", "category"), when("so_far > 0", say("so_far", euros("so_far"), "category")))
    notes = "CASE WHEN length(notes) > 20 THEN replace(notes, substr(notes, 1, 20), '****') ELSE '****' END"
    rest = (say("balance", euros("balance")), f"CASE WHEN balance < 500 THEN {say('balance_low')} WHEN balance > 5000 THEN {say('balance_good')} END", when("weekday >= 5", say("weekend")), when("day(date) >= 25", say("month_end")), when("notes <> ''", say("notes", notes)))
    key = "concat_ws('_', txn_id::VARCHAR, strftime(date, '%Y-%m-%d 00:00:00'), regexp_replace(printf('%.2f', amount), '(\\.\\d)0$', '\\1'))"
    return f"""{RICH_SQL}, p AS (SELECT merchant, avg(abs(amount)) AS mean, count(*) AS visits FROM ledger WHERE amount <= 0 AND merchant IS NOT NULL GROUP BY merchant),
      v AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY date, txn_id) AS visit, round(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) OVER (PARTITION BY month, category ORDER BY date, txn_id ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM ledger)
      SELECT {_id('narrative', key, 12)} AS chunk_id, 'transaction_narrative' AS chunk_type, strftime(date, '%Y-%m-%d') AS key,
      {told(say('opening', "strftime(date, '%A')", "strftime(date, '%B %d, %Y')"), f'CASE WHEN amount > 0 THEN {income} ELSE {expense} END', *rest)} AS text FROM v LEFT JOIN p USING (merchant)"""


def _spent_by(keys: str, name: str) -> str:
    return f"SELECT {keys}, {name}, round(sum(-amount), 2) AS s, count(*) AS n FROM ledger WHERE amount < 0 GROUP BY ALL"


def _daily() -> str:
    text = told(say("day", "strftime(date, '%A')", "strftime(date, '%B %d, %Y')"), say("day_count", "n"), when("income > 0", say("day_income", euros("income"))), when("expenses > 0", say("day_expenses", euros("expenses"))), when("expenses > 0", say("day_categories", "listing")),
                f"CASE WHEN {NET} > 0 THEN {say('day_positive', euros(NET))} WHEN {NET} < 0 THEN {say('day_negative', euros('-' + NET))} ELSE {say('day_balanced')} END", f"CASE WHEN expenses > 500 THEN {say('day_high')} WHEN expenses < 50 AND expenses > 0 THEN {say('day_low')} END")
    return f"""{RICH_SQL}, g AS (SELECT date, {TOTALS} FROM ledger GROUP BY date HAVING count(*) > 1), c AS ({_spent_by('date', 'category')}),
      t AS (SELECT date, {_listing('date', 'category', say('item', 'category', euros('s')))} AS listing FROM c GROUP BY date)
      SELECT {_id('daily', "strftime(date, '%Y-%m-%d')", 12)} AS chunk_id, 'daily_summary' AS chunk_type, strftime(date, '%Y-%m-%d') AS key, {text} AS text FROM g LEFT JOIN t USING (date)"""


def _weekly() -> str:
    text = told(say("week", "week", "year"), say("week_dates", "strftime(a, '%B %d')", "strftime(z, '%B %d')"), say("week_count", "n"), when("income > 0", say("week_income", euros("income"))), when("expenses > 0", say("week_expenses", euros("expenses"))), say("week_merchants", "listing"))
    return f"""{RICH_SQL}, g AS (SELECT year, week, min(date) AS a, max(date) AS z, {TOTALS} FROM ledger GROUP BY year, week HAVING count(*) > 3), c AS ({_spent_by('year, week', 'merchant')}),
      r AS (SELECT *, row_number() OVER (PARTITION BY year, week ORDER BY s DESC, merchant) AS r FROM c WHERE merchant IS NOT NULL),
      t AS (SELECT year, week, {_listing('', 'merchant', say('week_item', 'merchant', 'n', euros('s')))} AS listing FROM r WHERE r <= 3 GROUP BY year, week)
      SELECT printf('weekly_%d_w%02d', year, week) AS chunk_id, 'weekly_summary' AS chunk_type, printf('%d-W%02d', year, week) AS key, {text} AS text FROM g LEFT JOIN t USING (year, week)"""


def _monthly() -> str:
    text = told(
        say("month", "strftime(make_date(year, month, 1), '%B')", "year"), say("month_count", "n"), when("income > 0", told(say("month_income", euros("income")), say("month_sources", "sources"))), when("expenses > 0", told(say("month_expenses", euros("expenses")), say("month_categories", "costs"))),
        f"CASE WHEN {NET} > 0 THEN {say('month_savings', euros(NET), f'''printf('%.1f', round(100.0::DOUBLE * {NET} / income, 6))''')} ELSE {say('month_deficit', euros(f'abs({NET})'))} END",
        f"CASE WHEN expenses > income * 1.1 THEN {say('month_warning')} WHEN {NET} > income * 0.3 THEN {say('month_excellent')} END", say("month_daily", euros("expenses / 30")), say("month_top_day", "strftime(day, '%B %d')", euros("top")),
    )
    percent = "printf('%.1f', round(100.0::DOUBLE * s / expenses, 6))"
    return f"""{RICH_SQL}, g AS (SELECT year, month, {TOTALS} FROM ledger GROUP BY year, month), c AS ({_spent_by('year, month', 'category')}),
      i AS (SELECT year, month, category, round(sum(amount), 2) AS s FROM ledger WHERE amount > 0 GROUP BY ALL), si AS (SELECT year, month, {_listing('', 'category', say('item', 'category', euros('s')))} AS sources FROM i GROUP BY year, month),
      r AS (SELECT c.*, expenses, row_number() OVER (PARTITION BY year, month ORDER BY s DESC, category) AS r FROM c JOIN g USING (year, month)),
      sc AS (SELECT year, month, {_listing('', 'category', say('month_item', 'category', euros('s'), percent))} AS costs FROM r WHERE r <= 5 GROUP BY year, month),
      d AS (SELECT year, month, date, round(sum(amount), 2) AS s FROM ledger WHERE amount < 0 GROUP BY ALL), td AS (SELECT year, month, arg_min(date, (s, date)) AS day, -min(s) AS top FROM d GROUP BY year, month)
      SELECT printf('monthly_%d_%02d', year, month) AS chunk_id, 'monthly_summary' AS chunk_type, printf('%d-%02d', year, month) AS key, {text} AS text
      FROM g LEFT JOIN si USING (year, month) LEFT JOIN sc USING (year, month) LEFT JOIN td USING (year, month)"""


def _temporal() -> str:
    text = told(say("period", "kind", "period"), say("period_totals", "n", euros("income"), euros("expenses")), f"CASE WHEN {NET} > 0 THEN {say('period_surplus', euros(NET))} ELSE {say('period_deficit', euros(f'abs({NET})'))} END", say("period_categories", "listing"))
    kinds = (("daily", "strftime(date, '%Y-%m-%d')", 2), ("weekly", "printf('%d-W%02d', year, week)", 3), ("monthly", "printf('%d-%02d', year, month)", 1))
    rows = " UNION ALL ".join(f"SELECT '{k}' AS kind, {key} AS period, {least} AS least, amount, category FROM ledger" for k, key, least in kinds)
    return f"""{RICH_SQL}, x AS ({rows}), g AS (SELECT kind, period, {TOTALS} FROM x GROUP BY kind, period, least HAVING count(*) >= least),
      c AS (SELECT kind, period, category, round(sum(-amount), 2) AS s FROM x WHERE amount < 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind, period ORDER BY s DESC, category) AS r FROM c),
      t AS (SELECT kind, period, {_listing('', 'category', say('period_item', 'category', euros('s')), ', ')} AS listing FROM r WHERE r <= 3 GROUP BY kind, period)
      SELECT 'temporal_' || kind || '_' || substr(md5(period), 1, 8) AS chunk_id, kind || '_summary' AS chunk_type, period AS key, {text} AS text FROM g LEFT JOIN t USING (kind, period)"""


def _categories() -> str:
    day = "([" + ", ".join(f"'{d}'" for d in chunks.DAYS) + "])[peak + 1]"
    text = told(say("category", "category"), say("category_total", "n", euros("spent")), say("average", euros("spent / n")), say("category_merchants", "m", "first"), say("category_peak", day))
    return f"""{RICH_SQL}, e AS (SELECT * FROM ledger WHERE amount <= 0), g AS (SELECT category, count(*) AS n, round(sum(abs(amount)), 2) AS spent FROM e GROUP BY category HAVING count(*) >= 2),
      m AS (SELECT DISTINCT category, merchant FROM e WHERE merchant IS NOT NULL), f AS (SELECT category, count(*) AS m, array_to_string(list_sort(list(merchant))[1:5], ', ') AS first FROM m GROUP BY category),
      w AS (SELECT category, weekday, round(sum(abs(amount)), 2) AS s FROM e GROUP BY ALL), k AS (SELECT category, arg_max(weekday, (s, -weekday)) AS peak FROM w GROUP BY category)
      SELECT {_id('category', 'category', 8)} AS chunk_id, 'category_analysis' AS chunk_type, category AS key, {text} AS text FROM g LEFT JOIN f USING (category) JOIN k USING (category)"""


_ENTITY = """, e AS (SELECT * FROM ledger WHERE amount <= 0 AND merchant IS NOT NULL), g AS (SELECT merchant, count(*) AS n, round(sum(abs(amount)), 2) AS spent, array_to_string(list_sort(list(DISTINCT category)), ', ') AS categories, arg_max(abs(amount), (date, txn_id)) AS last FROM e GROUP BY merchant),
      d AS (SELECT merchant, date_diff('day', lag(date) OVER (PARTITION BY merchant ORDER BY date, txn_id), date) AS d FROM e WHERE amount < 0),
      k AS (SELECT merchant, CASE WHEN round(avg((d BETWEEN 6 AND 8)::INTEGER), 6) >= 0.6 THEN 'weekly' WHEN round(avg((d BETWEEN 28 AND 32)::INTEGER), 6) >= 0.6 THEN 'monthly' END AS kind FROM d WHERE d IS NOT NULL GROUP BY merchant)
"""


def _entities() -> str:
    text = told(say("entity", "merchant"), say("entity_total", "n", euros("spent")), say("average", euros("spent / n")), when("categories <> ''", say("entity_categories", "categories")), when("kind IS NOT NULL", say("entity_recurring", "kind")), f"CASE WHEN last > spent / n * 1.2 THEN {say('entity_above')} WHEN last < spent / n * 0.8 THEN {say('entity_below')} END")
    return f"{RICH_SQL}{_ENTITY} SELECT {_id('entity', 'merchant', 8)} AS chunk_id, 'entity_profile' AS chunk_type, merchant AS key, {text} AS text FROM g LEFT JOIN k USING (merchant) WHERE n >= 2"


_RECURRING = """, r AS (SELECT * FROM g JOIN k USING (merchant) WHERE kind IS NOT NULL), s AS (SELECT count(*) AS merchants, round(coalesce(sum(spent), 0), 2) AS total FROM r), mo AS (SELECT count(DISTINCT month) AS months FROM ledger)
"""


def _recurring() -> str:
    text = told(say("recurring", "merchants"), say("recurring_total", euros("total"), euros("total / months")), "items")
    return f"""{RICH_SQL}{_ENTITY}{_RECURRING}, f AS (SELECT * FROM r ORDER BY merchant LIMIT 5), t AS (SELECT string_agg({say('recurring_item', 'merchant', 'kind', euros('spent / n'))}, ' ' ORDER BY merchant) AS items FROM f)
      SELECT 'pattern_recurring' AS chunk_id, 'pattern_analysis' AS chunk_type, 'recurring' AS key, {text} AS text FROM s, mo, t WHERE merchants > 0"""


HIGH_SQL = "SELECT txn_id, merchant, round(-amount, 2) AS spent, date FROM ledger WHERE amount < 0 AND -amount > (SELECT avg(-amount) + 3.0 * stddev_samp(-amount) FROM ledger WHERE amount < 0)"
NEW_SQL = "SELECT merchant, txn_id, date, round(abs(amount), 2) AS size FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY date, txn_id) AS r FROM ledger WHERE merchant IS NOT NULL) WHERE r = 1 AND abs(amount) > 2.0 * (SELECT avg(-amount) FROM ledger WHERE amount < 0)"
_ANOMALIES = f", a AS (SELECT 'high_amount' AS kind, merchant, date, spent AS size, txn_id FROM ({HIGH_SQL}) UNION ALL SELECT 'new_merchant', merchant, date, size, txn_id FROM ({NEW_SQL}))"


def _anomaly() -> str:
    item = f"CASE WHEN kind = 'high_amount' THEN {say('anomaly_amount', euros('size'), 'merchant', 'date')} ELSE {say('anomaly_merchant', 'merchant', euros('size'))} END"
    return f"""{RICH_SQL}{_ANOMALIES}, f AS (SELECT * FROM a ORDER BY kind, date, txn_id LIMIT 5), t AS (SELECT string_agg({item}, ' ' ORDER BY kind, date, txn_id) AS items FROM f), n AS (SELECT count(*) AS n FROM a)
      SELECT 'pattern_anomalies' AS chunk_id, 'pattern_analysis' AS chunk_type, 'anomalies' AS key, {told(say('anomalies', 'n'), 'items')} AS text FROM n, t WHERE n > 0"""


def _counts() -> str:
    parts = {"narrative": (_narratives(), _daily(), _weekly(), _monthly()), "temporal": (_temporal(),), "categorical": (_categories(),), "entity": (_entities(),), "pattern": (_recurring(), _anomaly())}
    rows = " UNION ALL ".join(f"SELECT '{s}' AS strategy, chunk_type, text FROM ({q})" for s, qs in parts.items() for q in qs)
    return f"SELECT strategy, chunk_type, count(*) AS n, round(avg(length(text)), 4) AS mean_chars FROM ({rows}) GROUP BY ALL"


_PAIRS = {
    "chk_transactions": (chunks.transaction_narratives, _narratives()),
    "chk_days": (chunks.daily_summaries, _daily()),
    "chk_weeks": (chunks.weekly_summaries, _weekly()),
    "chk_months": (chunks.monthly_summaries, _monthly()),
    "chk_temporal": (chunks.temporal_chunks, _temporal()),
    "chk_categories": (chunks.category_chunks, _categories()),
    "chk_entities": (chunks.entity_chunks, _entities()),
    "chk_recurring": (chunks.recurring_chunk, _recurring()),
    "chk_anomalies": (chunks.anomaly_chunk, _anomaly()),
    "chk_counts": (lambda df: chunks.counts(chunks.build(df)), _counts()),
    "agg_high_amounts": (ops.high_amounts, f"{RICH_SQL} SELECT txn_id, merchant, spent FROM ({HIGH_SQL})"),
    "win_new_merchants": (lambda df: ops.new_merchants(df.where("merchant is not null")), f"{RICH_SQL} {NEW_SQL}"),
    "agg_recurring_total": (lambda df: chunks.recurring_summary(df).select("merchants", "total", "months", "per_month"), f"{RICH_SQL}{_ENTITY}{_RECURRING} SELECT merchants, total, months, round(total / months, 2) AS per_month FROM s, mo"),
}

QUERIES = {name: lambda spark, sf_dir, f=f: f(rich_ledger(spark, sf_dir)) for name, (f, _) in _PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in _PAIRS.items()}
