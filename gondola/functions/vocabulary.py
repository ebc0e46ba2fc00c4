"""Word lists, units and patterns that decide the results."""

from __future__ import annotations

import unicodedata

# Unit words, longest spelling first.
LIQUID_UNITS = ["mililitros", "mililitro", "ml", "litros", "litro", "lt", "l"]
SOLID_UNITS = ["quilogramas", "quilograma", "quilos", "quilo", "kg", "gramas", "grama", "g"]
COUNT_UNITS = ["unidades", "unidade", "unidadaes", "unid", r"un\.", "un"]

# Units converted to the base unit (x1000).
TO_GRAMS = ["kg", "quilo", "quilograma"]
TO_MILLILITRES = ["l", "lt", "litro"]

# Container and detail words removed from names.
DETAILS = [
    "lata", "vd", "pct", "cx", "fd", "pet", "pacote", "garrafa", "ln", "long neck", "descartavel", "frasco",
    "saco", "tablete", "cartela", "fardo", "balde", "galao", "tubo", "ampola", "pote", "pt", "kg", "litros",
    "litro", "lt", "caixa", "pack", "embalagem", "kit", "gfa", "gf", "bj", "bandeja", "sache", "refil", "rf",
    "economico", "economica", "ec", "squeeze", "sq", "tampa", "tp", "tamanho familia", "tradicional",
    r"trad\.", "trad", "uht", "homogeneizado", "esterilizado", "copo",
]

# Promotion phrases removed from names.
PROMOTIONS = [
    "gratis", r"\d*% de desconto", r"\d*% desconto", r"ed\. limitada", r"ed\. lim", r"ed\. l", "super economico",
    r"(?:\b(?:leve|l)(?:\s*(?:\+|mais|\d+))\s*(?:e\s)?)(?:pague|p)(?:\s*(?:\-|menos|\d+))?", r"leve pague",
]


def _any(words: list[str]) -> str:
    return "|".join(words)


# Patterns removed from a lower-cased, folded name, in this order.
REMOVALS = [
    rf"\b\d+(?:[.,]\d+)?\s*(?:{_any(LIQUID_UNITS + SOLID_UNITS)})\b\.?\s*(?:\bcada\b)?",
    rf"(?<!^)(?:c/|com)?\b(\d+(?:[.,]\d+)?)?\s*(?:{_any(DETAILS)})\b\.?\b",
    rf"\b(?:{_any(PROMOTIONS)})",
    rf"(?:c/|com)\s*(?:\d+(?:\/\d+)?)(?:\s*(?:{_any(COUNT_UNITS)})\b)?.*",
    rf"(?:\d+(?:\/\d+)?)(?:\s*(?:{_any(COUNT_UNITS)})\b).*",
    rf"\b(?:{_any(COUNT_UNITS)})\b.*",
    r"(?:\+|\.)\s*$",
]

# Connectives and their replacements, in this order.
CONNECTIVES = [
    (r"\bp/(?!\s?\d)", "para "),
    (r"\bs/(?!\s?\d)", "sem "),
    (r"\bc/(?!\s?\d)", "com "),
    (r"\b\s?/\s?(?!\s?\d)", " e "),
    (r"(?<!\d)\s*\+\s*", " + "),
    (r"(?<!\d)\.(?!\d)", ". "),
]

# Abbreviations and their expansions, applied in this order.
ABBREVIATIONS = {
    "z.": "zero", "res.": "reserva", "refrig.": "refrigerante", "perf.": "perfumado", "conc.": "concentrado",
    "liq.": "liquido", "g. res": "grande reserva", "bco": "branco", "tto": "tinto", "zr. ac": "zero acucar",
    "d. sec": "demi sec", "p. noir": "pinot noir", "c. sauv": "cabernet sauvignon", "malb.": "malbec",
    "chard": "chardonnay", "antibac": "antibacteriano", "hipoalerg": "hipoalergenico", "org.": "organico",
    "glut.": "gluten", "int.": "integral", "c. toro": "casa toro", "n. engl": "new england",
    "b. eleg": "brisa elegante", "en. flor": "energia floral", "f. v": "fragrancia verde",
    "f. intenso": "frescor intenso", "cuid.": "cuidado", "puro c.": "puro cuidado", "ess.": "essencial",
    "fiber pr.": "fiber protect", "chi": "chileno", "arg": "argentino", "fra": "frances", "por": "portugues",
    "esp": "espanhol", "ita": "italiano", "uru": "uruguaio", "caps": "capsula", "salg.": "salgado",
    "sha.": "shampoo", "cond.": "condicionador", "pent.": "pentear", "cr. pentear": "creme pentear",
    "vit.": "vitamina", "vita.": "vitamina", "cresc.": "crescimento", "saud.": "saudavel",
    "anticas.": "anticaspa", "antic.": "anticaspa",
}

# Characters that become several (or other) ASCII characters.
FOLD_MANY = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "Ĳ": "IJ", "ĳ": "ij",
    "¢": "C/", "£": "PS", "¤": "$?", "¥": "Y=", "§": "SS", "©": "(c)", "«": "<<", "®": "(r)", "°": "deg",
    "±": "+-", "»": ">>", "¼": " 1/4", "½": " 1/2", "¾": " 3/4", "–": "-", "—": "--", "…": "...", "€": "EUR",
    "™": "(tm)",
}
FOLD_ONE = {
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l", "Ħ": "H", "ħ": "h",
    "ı": "i", "Ŋ": "N", "ŋ": "n", " ": " ", "¡": "!", "¦": "|", "¨": '"', "¬": "!", "¯": "-",
    "´": "'", "µ": "u", "¶": "P", "·": "*", "¸": ",", "¿": "?", "×": "x", "÷": "/", "‘": "'", "’": "'",
    "“": '"', "”": '"', "•": "*", "‐": "-", "‑": "-",
}


def fold_pairs() -> tuple[str, str]:
    """(from, to) for ``translate``: accented Latin letters and digits by
    Unicode decomposition, then the fixed one-to-one values; combining marks and
    the soft hyphen have no counterpart and so are deleted."""
    table = {}
    for code in [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        if unicodedata.category(char)[0] not in "LN" or char in FOLD_MANY:
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            table[char] = base
    table.update(FOLD_ONE)
    dropped = "­" + "".join(chr(c) for c in range(0x0300, 0x0370))
    return "".join(table) + dropped, "".join(table.values())
