"""Rule cascades over descriptions: cleaning, categories and merchants, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword rules in their order of priority (the first that the description holds decides).
KEYWORDS = (
    ("supermercado", "Groceries"), ("alimentacion", "Groceries"), ("compra", "Groceries"), ("nomina", "Income"),
    ("transferencia recibida", "Income"), ("abono", "Income"), ("pension", "Income"), ("bonificacion", "Income"),
    ("seguridad social", "Taxes"), ("cuota seguridad social", "Taxes"), ("cuota", "Taxes"), ("comision", "Fees"),
    ("prestamo", "Loan"), ("credito", "Loan"), ("amortizacion", "Loan"), ("hipoteca", "Housing"),
    ("transferencia realizada", "Transfers"), ("transferencia enviada", "Transfers"), ("traspaso", "Internal Transfer"),
    ("traspaso programa", "Internal Transfer"), ("traspaso cuenta", "Internal Transfer"), ("bizum", "Transfers"),
    ("donacion", "Donations"), ("fundacion", "Donations"), ("alquiler", "Housing"), ("comunidad", "Housing"),
    ("ibi", "Housing"), ("gasolina", "Transportation"), ("gasolinera", "Transportation"), ("parking", "Transportation"),
    ("peaje", "Transportation"), ("autopista", "Transportation"), ("farmacia", "Healthcare"), ("clinica", "Healthcare"),
    ("hospital", "Healthcare"), ("medico", "Healthcare"), ("dentista", "Healthcare"), ("gimnasio", "Sports"),
    ("gym", "Sports"), ("deporte", "Sports"), ("netflix", "Entertainment"), ("spotify", "Entertainment"),
    ("hbo", "Entertainment"), ("disney", "Entertainment"), ("suscripcion", "Entertainment"), ("ong", "Donations"),
    ("cajero", "ATM"), ("retirada efectivo", "ATM"),
)
# Patterns on the cleaned, lower-cased description, in order.
PATTERNS = (
    ("Groceries", "supermercado|alimentacion|mercadona|carrefour|lidl|aldi|dia|eroski|alcampo|supermercats|ametller origen|roges supermercats|sapa|consum|ahorramas|froiz|condis|bonpreu|caprabo"),
    ("Food & Dining", "mcdonald|restaurant|restaurante|cafe|cafeteria|bar|pizzeria|burger|kebab|sushi|tapas|cerveceria|gelateria|umami|aramark|vencafesa|l0ki83|fa fum|telepizza|dominos|glovoapp|uber eats|just eat|deliveroo|comer|comida"),
    ("Transportation", "gasolina|gasolinera|repsol|cepsa|shell|bp|metro|bus|renfe|tmb|taxi|uber|cabify|parking|tunelspan"),
    ("Shopping", "zara|h&m|primark|amazon|aliexpress|ikea|decathlon|mango|corte ingles|fnac"),
    ("Entertainment", "netflix|spotify|hbo|disney|cine|teatro|concierto|ocio|gaming"),
    ("Healthcare", "farmacia|clinica|hospital|medico|dentista|salud|sanitario"),
    ("Utilities", "luz|gas|agua|telefono|internet|movistar|vodafone|orange|endesa|naturgy"),
    ("Services", "perruquer|peluquer|lavanderia|tintoreria|reparacion|mantenimiento|innovat|paypal|acens|taxdown|hosting"),
    ("Education", "uab|universidad|escuela|colegio|formacion|curso|udemy|coursera"),
    ("Tech & Software", r"claude\.ai|openai|github|google|microsoft|apple\.com|software|codificando bits"),
    ("Sports", "gym|gimnasio|fitness|deporte|sport|piscina|yoga|pilates|crossfit"),
    ("Donations", "fundacion|donacion|ong|caritas|cruz roja|unicef|level up"),
    ("Internal Transfer", "traspaso programa tu cuenta|traspaso cuenta"),
    ("Vending", "vending|maquina"),
)
# Merchants by the text that names them, in order.
MERCHANTS = (
    ("mcdonald", "McDonald's"), ("carrefour", "Carrefour"), ("zara", "Zara"), ("amazon", "Amazon"), ("netflix", "Netflix"),
    ("spotify", "Spotify"), ("mercadona", "Mercadona"), ("dia", "Dia"), ("lidl", "Lidl"), ("ikea", "IKEA"),
    ("decathlon", "Decathlon"), ("el corte ingles", "El Corte Inglés"), ("mediamarkt", "MediaMarkt"), ("fnac", "FNAC"),
    ("h&m", "H&M"), ("primark", "Primark"), ("bbva", "BBVA"), ("santander", "Santander"), ("endesa", "Endesa"),
    ("naturgy", "Naturgy"), ("vodafone", "Vodafone"), ("movistar", "Movistar"),
)
# What cleaning removes, in order.
CLEANING = (r"^COMPRA EN\s+", r"^PAGO EN\s+", r"^TRANSFERENCIA DE\s+", r"^RECIBO DE\s+", r"\*{4}\d{4}", r"\b\d{10,}\b")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_description(c: Column) -> Column:
    return F.regexp_replace(reduce(lambda x, p: F.regexp_replace(x, p, ""), CLEANING, stripped(c)), r"\s+", " ")


def _first(cases: list[tuple[Column, str]], otherwise: Column) -> Column:
    head, *rest = cases
    return reduce(lambda x, case: x.when(case[0], F.lit(case[1])), rest, F.when(head[0], F.lit(head[1]))).otherwise(otherwise)


def categorise(description: Column, amount: Column) -> Column:
    """Pension plans by sign, then keywords, then income (no refunds), then patterns on the cleaned text, then Other."""
    text = F.coalesce(description, F.lit(""))
    # the cascade is a function of one struct, so that the text is lowered and cleaned once and not in each of its cases
    known = F.struct(F.lower(text).alias("low"), F.lower(clean_description(text)).alias("cleaned"), amount.alias("amount"))

    def cascade(x: Column) -> Column:
        low, value = x["low"], x["amount"]
        plan = low.contains("plan de pensiones")
        cases = [(plan & (value < 0), "Savings"), (plan & (value > 0), "Income")]
        cases += [(low.contains(k), v) for k, v in KEYWORDS]
        cases += [((value > 0) & ~low.contains("devolucion"), "Income")]
        cases += [(x["cleaned"].rlike(p), v) for v, p in PATTERNS]
        return _first(cases, F.lit("Other"))

    return F.get(F.transform(F.array(known), cascade), F.lit(0))


def merchant(description: Column) -> Column:
    """A known merchant, else the word after a card payment, else Transfer, else the first long word, else Unknown."""
    text = F.coalesce(description, F.lit(""))
    low = F.lower(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    long = lambda ws, stop: F.get(F.filter(ws, lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*stop)), F.lit(0))
    card = low.contains("pago con tarjeta") | low.contains("compra tarjeta")
    by_card = F.when(card, F.initcap(long(F.slice(words, 3, 1_000_000), ("tarjeta",))))
    first = F.initcap(long(words, ("pago", "con", "tarjeta", "compra")))
    rest = F.coalesce(by_card, F.when(low.contains("transferencia"), F.lit("Transfer")), first, F.lit("Unknown"))
    return _first([(low.contains(k), v) for k, v in MERCHANTS], rest)


def spanish_decimal(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".").try_cast("double")
