"""Scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def normalize(c: Column) -> Column:
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(f"({V.TOKEN})"), F.lit(1))


def clean(c: Column) -> Column:
    return reduce(lambda x, rx: F.regexp_replace(x, f"(?iU){rx}", " "), V.NOISE, F.coalesce(c, F.lit("")))


def terms(c: Column, lemmas: Column | None = None, stopwords: tuple[str, ...] = V.STOPWORDS, cleaned: bool = True) -> Column:
    """Lemmas of a text without stop words, repeats kept. lemmas: a map from token to lemma; tokens without one stand for themselves."""
    lemma = (lambda t: F.coalesce(F.try_element_at(lemmas, t), t)) if lemmas is not None else (lambda t: t)
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    long = F.filter(tokenize(clean(c) if cleaned else c), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))
    pairs = F.filter(F.transform(long, lambda t: F.struct(t.alias("t"), lemma(t).alias("l"))), lambda p: ~F.array_contains(stop, p["t"]) & ~F.array_contains(stop, p["l"]))
    return F.transform(pairs, lambda p: p["l"])


def rounded(value: Column, n: int) -> Column:
    """value to n decimals as SQL engines round doubles: scaled first. F.round takes the shortest decimal of the double instead, by which 0.44999999999999996 is 0.4."""
    return F.round(value * 10.0**n) / 10.0**n


def level(code: Column, n: int) -> Column:
    """The first n characters of a code: 2 class, 5, 8."""
    return F.substring(F.coalesce(code, F.lit("")), 1, n)


def is_goods(code: Column) -> Column:
    return F.coalesce(F.substring(code, 1, 2).try_cast("int") <= 32, F.lit(False))


def intent(text: Column) -> Column:
    """goods or services by the words of a text, the earlier one if both are there; else null."""
    at = lambda rx: F.when(F.coalesce(text, F.lit("")).rlike(f"(?iU){rx}"), F.length(F.regexp_extract(text, f"(?isU)^(.*?){rx}", 1)))
    g, s = at(V.GOODS), at(V.SERVICES)
    return F.when(g.isNotNull() & (s.isNull() | (g < s)), "goods").when(s.isNotNull(), "services")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    n = F.abs(n.cast("long"))
    form = F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)
    return F.concat_ws(" ", n.cast("string"), form)


def inn(c: Column) -> Column:
    """10 or 12 digits; 9 and 11 get back the zero that a spreadsheet dropped."""
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")
    d = F.when(F.length(d).isin(9, 11), F.concat(F.lit("0"), d)).otherwise(d)
    return F.when(F.length(d).isin(10, 12), d)


def price(c: Column) -> Column:
    """Spaces and currency dropped, commas as points, all points but the last dropped; null if that is no number."""
    s = F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9,.\-]", ""), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_replace(s, r"\.(?=.*\.)", ""), F.lit("")).try_cast("double")


def yes_no(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.isin(*V.YES), True).when(s.isin(*V.NO), False)


def platform(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when((s == "эм") | s.contains("магазин") | s.contains("eshop") | (s == "em"), "ЭМ").when(s.contains("аис") | s.contains("ais") | s.contains("гз"), "АИС ГЗ")


def short_name(name: Column, inn_: Column) -> Column:
    """Legal forms in short; people's names in title case."""
    name = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    up, tried = F.upper(name), []
    for full, short in V.LEGAL_FORMS:
        tried.append(F.when(up.startswith(full), F.concat(F.lit(short), F.substring(name, len(full) + 1, 1 << 20))))
        tried.append(F.when(up.endswith(full), F.concat_ws(" ", F.lit(short), F.trim(F.substring(name, F.lit(1), F.length(name) - len(full))))))
    person = F.when((F.length(inn_) == 12) & ~up.startswith("ИП"), F.concat(F.lit("ИП "), F.initcap(name)))
    rest = F.substring(name, 4, 1 << 20)
    titled = F.when(up.startswith("ИП ") & (rest == F.upper(rest)), F.concat(F.lit("ИП "), F.initcap(rest)))
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(*tried, person, titled, name))


def price_fit(price_: Column, median: Column) -> Column:
    """1 at the supplier's usual price, falling with orders of magnitude; 0 if either is unknown or not positive."""
    fit = F.exp(-F.pow(F.ln(price_ / median), F.lit(2)) / F.lit(2 * 1.5**2))
    return F.when((price_ > 0) & (median > 0), fit).otherwise(0.0)


def decay(days: Column, half_life: int = V.HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / F.lit(half_life))


def okved_role(code: Column) -> Column:
    n = F.split(code, r"\.")[0].try_cast("int")
    return (
        F.when(n.isNull(), None)
        .when(n.between(1, 3) | n.between(5, 9), "manufacturer")
        .when(n.between(10, 33), F.when(code.startswith("33."), "service").otherwise("manufacturer"))
        .when(n.between(41, 43), "contractor")
        .when(n == 45, F.when(code.startswith("45.2"), "service").otherwise("distributor"))
        .when(n == 46, "distributor").when(n == 47, "supplier").otherwise("service")
    )


def okpd_role(cls: Column) -> Column:
    n = cls.try_cast("int")
    return F.when(n <= 32, "supplier").when(n.between(41, 43), "contractor").when(n.isNotNull(), "service")
