import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import pii, rules
from ledgerloom.sources.statement import read_statement

STATEMENT = """Fecha Operación;Fecha Valor;Concepto;Movimiento;Importe;Divisa;Saldo
03/11/2031;04/11/2031;TRANSFERENCIA POR OBRAS DEL PATIO;PAGO;-1.204,75;EUR;811,03
09/11/2031;09/11/2031;PEAJE TUNEL DEL NORTE;PAGO;-6,10;EUR;804,93
21/12/2031;21/12/2031;PENSION TRIMESTRAL;ABONO;3.310,40;EUR;4.115,33
Fecha;x;Concepto;x;x;x;x
;;APUNTE SIN DIA;PAGO;-1,00;EUR;1,00
"""


def test_statement(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(STATEMENT)
    got = [(r.date, r.amount, r.category, r.merchant, r.balance) for r in read_statement(spark, str(path)).orderBy("date").collect()]
    day = lambda m, d: datetime.date(2031, m, d)
    assert got == [(day(11, 3), -1204.75, "Other", "Transfer", 811.03), (day(11, 9), -6.1, "Transportation", "Peaje", 804.93), (day(12, 21), 3310.4, "Income", "Pension", 4115.33)]
    with pytest.raises(NotImplementedError):
        read_statement(spark, "x.pdf")
    with pytest.raises(ValueError):
        read_statement(spark, "x.doc")


@pytest.mark.parametrize(("text", "amount", "category", "merchant"), [("COMPRA AMAZON", -9.0, "Groceries", "Amazon"), ("RESTAURANTE PEPE", -9.0, "Food & Dining", "Restaurante"), ("PAGO CON TARJETA EN LIBRERIA SOL", -9.0, "Other", "Libreria"), ("", -1.0, "Other", "Unknown"), (None, 1.0, "Income", "Unknown"), ("PLAN DE PENSIONES", -5.0, "Savings", "Plan")])
def test_rules(spark, text, amount, category, merchant):
    df = spark.createDataFrame([(text, amount)], "d string, a double")
    assert tuple(df.select(rules.categorise(F.col("d"), F.col("a")), rules.merchant(F.col("d"))).first()) == (category, merchant if text != "PLAN DE PENSIONES" else "Plan")


def dni(number: int) -> str:
    return f"{number:08d}{pii.DNI_LETTERS[number % 23]}"


def iban(account: str) -> str:
    return f"ES{98 - int(account + '142800') % 97:02d}{account}"


def card(first: str) -> str:
    return next(first + str(d) for d in range(10) if pii.luhn(first + str(d)))


def test_checks():
    account = "31415926535897932384"
    assert pii.dni_valid(dni(27_182_818)) and not pii.dni_valid(f"27182818{'A' if dni(27_182_818)[-1] != 'A' else 'B'}")
    assert pii.iban_valid(iban(account)) and not pii.iban_valid("ES00" + account)
    good = card("577215664901532")
    assert pii.luhn(good) and not pii.luhn(good[:-1] + str((int(good[-1]) + 1) % 10)) and not pii.luhn("12345")


def test_pii(spark):
    account, number = iban("27182818284590452353"), dni(16_180_339)
    text = f"CUOTA DE LA PEÑA, dni {number} cuenta {account}"
    assert [(s[0], s[4]) for s in pii.spans(text)] == [("ES_DNI", 1.0), ("ES_IBAN", 1.0)]
    assert pii.masked(text) == f"CUOTA DE LA PEÑA, dni ********X cuenta {account[:4]}...{account[-4:]}"
    good = card("577215664901532")
    assert pii.masked(f"x {good}") == f"x ****-****-****-{good[-4:]}"
    assert pii.masked(None) is None and pii.masked("") == ""
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(pii.mask(F.col("t"), "replace")).collect()] == ["CUOTA DE LA PEÑA, dni <ES_DNI> cuenta <ES_IBAN>", None, ""]
    assert [s[0] for s in pii.spans("Ref:ZX81SPECTRUM y 612 98 40 07")] == ["TRANSFER_REF", "ES_PHONE"]


def test_confidence_by_context():
    """A context word adds by its distance to the first place of the match; a failed check takes away."""
    number = dni(16_180_339)
    bad = number[:-1] + ("T" if number[-1] != "T" else "R")
    score = lambda t: pii.spans(t)[0][4]
    assert score(f"x {bad}") == pytest.approx(0.6) and score(f"nif {bad}") == pytest.approx(0.8)
    assert score(f"nif {'-' * 30} {bad}") == pytest.approx(0.7) and score(f"nif {'-' * 60} {bad}") == pytest.approx(0.6)
    assert score("QWE135790") == pytest.approx(0.7) and score("tpv QWE135790") == pytest.approx(0.9)


def test_escalation():
    name = lambda t: [("PERSON", "Pepa", t.find("Pepa"), t.find("Pepa") + 4, 0.45)] if "Pepa" in t else []
    number = dni(16_180_339)
    assert pii.escalated(f"dni {number}", name)[2] == "static" and pii.escalated("Pepa") == ([], 0.0, "static")
    found, score, layer = pii.escalated("para Pepa", name)
    assert (len(found), score, layer) == (1, 0.45, "second")
    found, score, layer = pii.escalated("para Pepa", name, validate=True)
    assert (found[0][4], layer) == (0.75, "validated") and score == 0.75
    weak = lambda t: [("CREDIT_CARD", "1234 5678 9012 3456", 0, 19, 0.3), ("PERSON", "x", 30, 31, 0.2)]
    assert pii.escalated("nada", weak, validate=True)[0] == []


def test_anonymise(spark):
    number = dni(16_180_339)
    df = spark.createDataFrame([(1, f"dni {number}", None, "QWE135790"), (2, "nada", "", None)], "id int, concept string, description string, notes string")
    got = pii.anonymise(df).orderBy("id").collect()
    assert got[0].asDict() | {"pii_confidence": 0} == {"id": 1, "concept": "dni ********X", "description": None, "notes": "<MERCHANT_CODE>", "pii_count": 2, "pii_kinds": ["ES_DNI", "MERCHANT_CODE"], "pii_confidence": 0}
    assert got[0].pii_confidence == pytest.approx(0.85) and (got[1].concept, got[1].pii_count, got[1].pii_confidence) == ("nada", 0, 0.0)
    assert pii.anonymise(df.select("id")).columns == ["id", "pii_count", "pii_kinds", "pii_confidence"]
    learnt = pii.learn(spark.createDataFrame([("A", "ABC12"), ("A", "XYZ99"), ("A", "ab1"), ("B", "Ab")], "kind string, text string")).collect()
    assert [(r.kind, r.n) for r in learnt] == [("A", 1)] and learnt[0].patterns == [r"[A-Z][A-Z][A-Z]\[a-z]\[a-z]"]
