"""Registry enrichment, market roles, and companies without a bidding history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import fixed_values as V
from bidloom.functions.scalars import is_goods, okpd_role, okved_role, rounded, short_name
from bidloom.operators.marts import Market


def parts(c: Column) -> Column:
    """Non-empty pieces of a list joined by semicolons."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")


def merged_registry(offline: DataFrame, cached: DataFrame) -> DataFrame:
    """Registry rows where there are any, else cached ones; phone, email and licences from the cache first. Both: inn and columns, one row each."""
    columns = list(dict.fromkeys([*offline.columns, *cached.columns]))
    a, b = offline.alias("a"), cached.alias("b")
    both = a.join(b, F.col("a.inn") == F.col("b.inn"), "full_outer")
    first = {"phone", "email", "has_licenses"}

    def pick(c: str) -> Column:
        sides = [F.col(f"{s}.{c}") for s, df in (("a", offline), ("b", cached)) if c in df.columns]
        return F.coalesce(*(sides[::-1] if c in first else sides)).alias(c)

    return both.select(*map(pick, columns))


def enriched(cards: DataFrame, registry: DataFrame, roster: DataFrame, unfair: DataFrame) -> DataFrame:
    """Cards with company data. registry: SME register; roster: state register (inn, name, head, is_active); unfair: inn, in_rnp, was_in_rnp, since."""
    size = F.when(F.col("msp_category") == "микро", "micro").when(F.col("msp_category") == "малое", "small").when(F.col("msp_category") == "среднее", "medium").otherwise("unknown")
    r = registry.withColumn("__reg", F.lit(True)).withColumnRenamed("name", "__name").drop("region_code")
    e = roster.select("inn", F.col("name").alias("__other"), F.col("head"), F.col("is_active"), F.lit(True).alias("__roster"))
    u = unfair.select("inn", "in_rnp", "was_in_rnp", "since")
    out = cards.join(r, "inn", "left").join(e, "inn", "left").join(u, "inn", "left").withColumn("company_name", F.coalesce(short_name(F.coalesce("__name", "__other"), F.col("inn")), F.concat(F.lit("ИНН "), F.col("inn"))))
    sources = F.array_compact(F.array(F.when(F.col("__reg"), "Реестр МСП"), F.when(F.col("__roster"), "ЕГРЮЛ")))
    warning = F.when(F.col("in_rnp"), F.concat_ws(" с ", F.lit("Внимание: состоит в реестре недобросовестных поставщиков"), F.col("since")))
    past = F.when(~F.coalesce("in_rnp", F.lit(False)) & F.col("was_in_rnp"), "Ранее состоял в реестре недобросовестных поставщиков (исключён)")
    told = F.array_compact(F.concat(F.array(warning), F.coalesce("reasons", F.array().cast("array<string>")) if "reasons" in cards.columns else F.array().cast("array<string>"), F.array(past)))
    products = F.transform(F.slice(parts(F.col("products")), 1, 5), lambda p: F.struct(F.split(p, r"\|")[0].alias("code"), F.regexp_replace(p, r"^[^|]*\|", "").alias("name")))
    return out.withColumns({"size_class": size, "sources": sources, "reasons": told, "product_list": products, "is_active": F.coalesce("is_active", F.lit(True)), "in_msp_registry": F.coalesce("__reg", F.lit(False))}).drop("__name", "__other", "__reg", "__roster")


def roles(companies: DataFrame) -> DataFrame:
    """companies: inn, name, okved_main, okved_extra, products, n_classes, top_cls. Adds a score per role, role, share, level, alternative and the number of signals."""
    names = list(V.ROLES)
    main, extra = okved_role(F.col("okved_main")), F.transform(parts(F.col("okved_extra")), okved_role)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = companies.withColumn("__extra", extra).withColumn("__main", main).withColumn("__okpd", F.when(F.col("okved_main").isNull() & F.col("top_cls").isNotNull(), okpd_role(F.col("top_cls"))))
    count = {r: F.size(F.filter("__extra", (lambda role: lambda x: x == role)(r))) for r in names}
    top_extra = F.greatest(*count.values())
    for k, r in enumerate(names):
        earlier = reduce(lambda a, b: a & b, [count[x] < count[r] for x in names[:k]], F.lit(True))
        made = (r == "manufacturer") and (F.size(parts(F.col("products"))) > 0)
        named = F.col("name").rlike(f"(?iU){V.ROLE_NAMES[r]}") if r in V.ROLE_NAMES else F.lit(False)
        broad = F.col("n_classes") >= 8 if r == "supplier" else F.lit(False)
        made = made if made is not False else F.lit(False)
        score = (
            F.when(F.col("__main") == r, 3.0).otherwise(0.0) + zero(F.try_divide(1.5 * count[r], F.size("__extra"))) + F.when(made, 2.0).otherwise(0.0) + F.when(named, 1.5).otherwise(0.0)
            + F.when(F.col("__okpd") == r, 1.5).otherwise(0.0) + F.when(broad, 1.0 + F.least((F.col("n_classes") - 8) / 10, F.lit(1.0))).otherwise(0.0)
        )
        listed = (count[r] >= 3) & (count[r] == top_extra) & earlier
        signals = sum((F.when(c, 1).otherwise(0) for c in (F.col("__main") == r, listed, made, named, F.col("__okpd") == r, broad)), F.lit(0))
        out = out.withColumn(f"role_{r}", score).withColumn(f"__n_{r}", signals)
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"role_{r}")).alias("minus"), F.lit(k).alias("k"), F.lit(r).alias("role"), F.col(f"__n_{r}").alias("n")) for k, r in enumerate(names)]))
    total = reduce(lambda a, b: a + b, [F.col(f"role_{r}") for r in names])
    out = out.withColumn("__ranked", ranked).withColumn("__share", F.try_divide(-F.col("__ranked")[0]["minus"], total))
    best, second = F.col("__ranked")[0], F.col("__ranked")[1]
    level = F.when((F.col("__share") >= 0.8) & (best["n"] >= 2), "высокая").when(F.col("__share") >= 0.55, "средняя").when(F.col("__share").isNotNull(), "низкая").otherwise("")
    return out.withColumns(
        {
            "role": F.when(F.col("__share").isNotNull(), best["role"]), "role_confidence": F.round(F.coalesce("__share", F.lit(0.0)), 2), "role_level": level,
            "role_alt": F.when(F.col("__share").isNotNull() & (-second["minus"] >= -0.3 * best["minus"]) & (second["n"] > 0), second["role"]),
        }
    ).drop("__extra", "__main", "__okpd", "__ranked", "__share", *[f"__n_{r}" for r in names])


def okved_mapping(wins: DataFrame, registry: DataFrame) -> DataFrame:
    """cls, okved5, w: main activities of the winners of a product class. wins: inn, cls, w."""
    return wins.join(registry.filter("okved_main is not null and okved_main <> ''").select("inn", F.substring("okved_main", 1, 5).alias("okved5")), "inn").groupBy("cls", "okved5").agg(F.sum("w").alias("w"))


def activity_plans(shares: DataFrame, mapping: DataFrame) -> DataFrame:
    """query_id, okved5, weight: activities looked for: of the first two codes the class itself, and up to four that its winners have. shares: query_id, code8, share, place."""
    wanted = shares.filter("place <= 2").select("query_id", F.substring("code8", 1, 5).alias("cls"), "share", "place")
    whole = Window.partitionBy("cls")
    typical = mapping.withColumn("total", F.sum("w").over(whole)).withColumn("at", F.row_number().over(whole.orderBy(F.desc("w"), "okved5"))).filter("at <= 4 and okved5 <> cls").filter(F.col("w") / F.col("total") >= 0.08)
    learned = wanted.join(typical, "cls").select("query_id", "okved5", ((1.5 * F.col("w") / F.col("total") + 0.5) * F.col("share")).alias("weight"))
    return wanted.select("query_id", F.col("cls").alias("okved5"), (2.0 * F.col("share")).alias("weight")).union(learned)


def pool_scores(plans: DataFrame, pool: DataFrame, shares: DataFrame, market: Market = Market()) -> DataFrame:
    """query_id, inn, okved5 (main), local, match (largest plan weight), pool_score: companies of the pool whose main or further activities fit. Services stay local."""
    main = F.substring(F.coalesce("okved_main", F.lit("")), 1, 5)
    companies = pool.select("inn", main.alias("main5"), F.array_distinct(F.transform(parts(F.col("okved_extra")), lambda x: F.substring(x, 1, 5))).alias("extra5"), F.coalesce("employees", F.lit(0)).alias("employees"), "region_code")
    keys = companies.select("inn", F.explode(F.concat(F.array(F.struct(F.col("main5").alias("okved5"), F.lit(1.0).alias("part"))), F.transform("extra5", lambda x: F.struct(x.alias("okved5"), F.lit(0.4).alias("part"))))).alias("k")).select("inn", "k.okved5", "k.part")
    hits = plans.join(keys, "okved5")
    # A company that has an activity as main and further one takes it once for `match`, twice for the score.
    matched = hits.groupBy("query_id", "inn").agg(F.sum(F.col("weight") * F.col("part")).alias("s"), F.max(F.col("weight") * F.col("part")).alias("match"))
    goods = shares.filter("place = 1").select("query_id", is_goods(F.col("code8")).alias("goods"))
    local = F.coalesce(F.col("region_code").isin(market.home, market.near), F.lit(False))
    static = 0.25 * F.log1p("employees") + F.when(F.col("region_code") == market.home, 0.2).otherwise(0.0)
    rows = matched.join(companies, "inn").join(goods, "query_id").withColumn("local", local).filter("goods or local")
    return rows.select("query_id", "inn", F.col("main5").alias("okved5"), "local", "match", F.round(F.col("s") + static, 9).alias("pool_score"))


def diverse(scores: DataFrame, limit: int = 10, window: int = 40) -> DataFrame:
    """The best companies of each query, at most 60 % with one activity and 40 % from afar.

    Each choice depends on those before it, so the bounded head of a query's ranking (limit * window rows) is folded over one array."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pool_score"), "inn"))
    head = scores.withColumn("place", place).filter(F.col("place") <= limit * window)
    columns = [c for c in head.columns if c not in ("query_id", "place")]
    ranked = head.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("ranked"))

    def take(taken: Column, x: Column) -> Column:
        alike = F.size(F.filter(taken, lambda t: t["okved5"].eqNullSafe(x["okved5"])))
        afar = F.size(F.filter(taken, lambda t: ~t["local"]))
        fits = (F.size(taken) < limit) & (alike < max(2, int(limit * 0.6))) & (x["local"] | (afar < max(1, int(limit * 0.4))))
        return F.when(fits, F.concat(taken, F.array(x))).otherwise(taken)

    none = F.slice("ranked", 1, 0)
    chosen = ranked.select("query_id", F.posexplode(F.aggregate("ranked", none, take)).alias("at", "x"))
    return chosen.select("query_id", *[F.col(f"x.{c}") for c in columns], (F.col("at") + 1).alias("place")).select(*head.columns)


def new_company_points(rows: DataFrame, registry: DataFrame, unfair: DataFrame, market: Market = Market()) -> DataFrame:
    """Absolute score of companies without a history, 80 at most: activity, size, years in the register, region, contacts; halved on the register of unfair suppliers."""
    extra = [F.col(c) for c in ("phone", "email") if c in registry.columns]
    year = F.substring(F.coalesce("msp_since", F.lit("")), -4, 4).try_cast("int")
    r = registry.select("inn", "region_code", F.coalesce("employees", F.lit(0)).alias("emp"), year.alias("year"), F.coalesce(*extra, F.lit(None).cast("string")).isNotNull().alias("contact"))
    out = rows.join(r, "inn").join(unfair.select("inn", "in_rnp"), "inn", "left")
    points = (
        rounded(F.least(25 * F.col("match"), F.lit(50.0)), 1) + rounded(15 * F.least(F.log1p("emp") / F.log1p(F.lit(100.0)), F.lit(1.0)), 1)
        + F.when(F.col("year") <= 2023, 5.0).when(F.col("year").isNotNull(), 2.0).otherwise(0.0)
        + F.when(F.col("region_code") == market.home, 5.0).when(F.col("region_code") == market.near, 3.0).otherwise(0.0) + F.when(F.col("contact"), 5.0).otherwise(0.0)
    )
    total = rounded(points, 1)
    return out.withColumn("score", F.when(F.col("in_rnp"), rounded(total * 0.5, 1)).otherwise(total)).drop("emp", "year", "contact", "in_rnp")
