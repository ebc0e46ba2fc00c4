import random
import re

from pyspark.sql import functions as F

from gondola.functions import measure as M
from gondola.functions import text as X
from gondola.functions import vocabulary as V

WORDS = (
    "arroz leite 2l 1,5kg 500 g c/ 6 un unidades com 12 lata pct kit garrafas leve 3 pague 2 gratis 10% de desconto "
    "p/ s/ c/12 + - . refrig. z. res. conc. g. c. toro vit. vita cada un. 350ml lt 4/6 tradicional trad. uht copo "
    "presunto a/b 1/2 5.5 x+y w.z long neck ed. l tamanho familia"
).split(" ")


def names(n=1500, seed=7):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").repartition(4)
    return [r[1] for r in sorted(df.select("i", build(F.col("s"))).collect())]


def stable(name):
    for pattern in V.REMOVALS:
        while (new := re.sub(pattern, "", name, flags=re.I)) != name:
            name = new
    return name


def test_remove_patterns_reaches_the_fixpoint(spark):
    values = names()
    assert column(spark, values, X.remove_patterns) == [stable(v) for v in values]


def test_remove_patterns_many_passes(spark):
    # Each pass uncovers the next match.
    deep = "a" + " 1" * 60 + " un" * 60 + "+" * 40 + ". " * 30
    assert column(spark, [deep], X.remove_patterns) == [stable(deep)]


def test_connectives_and_abbreviations(spark):
    values = names(seed=8)

    def connect(s):
        for pattern, new in V.CONNECTIVES:
            s = re.sub(pattern, new, s, flags=re.I)
        return s

    def expand(s):
        for key, new in V.ABBREVIATIONS.items():
            s = re.sub(r"(?<!\S)" + re.escape(key.rstrip(".")) + r"\.?(?!\S)", new, s, flags=re.I)
        return s

    assert column(spark, values, X.expand_connectives) == [connect(v) for v in values]
    assert column(spark, values, X.expand_abbreviations) == [expand(v) for v in values]


def test_title_and_spaces(spark):
    values = ["2l d'agua", "  a b \t c  ", "CAFÉ coM leite", "x"]
    assert column(spark, values, X.title_case) == [v.title() for v in values]
    assert column(spark, values, X.strip_all) == [" ".join(v.split()) for v in values]


def test_fold(spark):
    values = ["Pão de Açúcar", "Strauß ½ kg nº 5ª", "café", "œuf – “x” €2", "日本 plain"]
    want = ["Pao de Acucar", "Strauss  1/2 kg no 5a", "cafe", 'oeuf - "x" EUR2', "日本 plain"]
    assert column(spark, values, X.fold_accents) == want


def test_replace_word_and_original(spark):
    assert column(spark, ["Sal. sal salgado SAL"], lambda c: X.replace_full_word(c, "sal", "x$1")) == ["x$1. x$1 salgado x$1"]
    rows = spark.createDataFrame([("Molho Original X", "acme"), ("Molho Original X", " Original ")], "n string, b string")
    got = [r[0] for r in rows.select(X.remove_word_original(F.col("n"), F.col("b"))).collect()]
    assert got == ["Molho  X", "Molho Original X"]


def test_private_label(spark):
    rows = spark.createDataFrame([("Arroz Giassi Tipo 1 Giassi", "giassi"), ("Arroz", "giassi"), ("Sal Giassi", "acme")], "n string, b string")
    cut = X.strip_private_label(F.col("n"), F.col("b"), F.lit("giassi"))
    got = [tuple(r[0]) for r in rows.select(cut).collect()]
    assert got == [("Arroz Tipo 1 Giassi", ""), ("Arroz", ""), ("Sal Giassi", "acme")]


EDGE = [
    (None, None, "Arroz 1,5kg", "g", 5000),
    (None, None, "Kit 2 garrafas", "g", 2),
    (None, None, "Cerveja 2 latas 350ml", "ml", 2000),
    (None, None, "Fralda c/6/12", "un", 12),
    (None, None, "Presunto Fatiado", "un", 1),
    (None, None, "Leite 2 litros", "litros", 2),
    (["0.5"], ["KG"], "x", "g", 500),
    (["6"], ["un"], "Caneta", "un", 6),
    (None, None, "Sal", "", 0),
    (["1", "2"], ["kg"], "Sal 3 kg", "g", 3000),
    (["x"], ["kg"], "Sal", "", 0),
    (["0"], ["kg"], "Sal", "", 0),
    (["6"], ["un."], "Caneta", "", 0),
    (["1.001"], ["kg"], "Sal", "g", 1000),
    ([""], ["kg"], "Sal 7 un x", "un", 1),
]


def test_parse_measure_edges(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(EDGE)], "i int, w array<string>, m array<string>, n string")
    got = sorted(df.select("i", M.parse_measure(F.col("w"), F.col("m"), F.col("n"))).collect())
    assert [tuple(r[1]) for r in got] == [r[3:] for r in EDGE]


def test_scalar_weight_quirk_and_strict(spark):
    df = spark.createDataFrame([("500", "Sal")], "w string, n string")
    quirk = M.parse_measure(F.array(M.first_character(F.col("w"))), F.array(F.lit("g")), F.col("n"))
    strict = M.parse_measure(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit("Arroz 1,5kg"), True)
    row = df.select(quirk, strict).first()
    assert tuple(row[0]) == ("g", 5) and tuple(row[1]) == ("g", 1500)


def test_unit_count_against_python(spark):
    unit = "|".join(V.COUNT_UNITS)

    def count(name):
        for pattern in (rf"(?:c/|com)\s*(\d+(?:/\d+)?)(?:\s*(?:{unit}))?", rf"(\d+(?:/\d+)?)(?:\s*(?:{unit}))(?!\s*\w)"):
            if found := re.search(pattern, name, re.I):
                return float(found.group(1).split("/")[-1])
        return 1.0 if re.search(unit, name, re.I) else None

    values = names(seed=9)
    assert column(spark, values, M.unit_count) == [count(v) for v in values]


def test_search_tokens_and_grams(spark):
    assert column(spark, ["Coca-Cola d'agua 1,5 L."], X.search_tokens) == [["coca", "cola", "d'agua", "1,5", "l"]]
    grams = column(spark, ["Leite a" + "b" * 30], X.edge_ngrams)[0]
    assert grams[:5] == ["l", "le", "lei", "leit", "leite"] and max(map(len, grams)) == 20
