"""Demo tables with planted effects, generated row-wise in Spark.

Every value comes from a hash of the seed, the row and the column, so tables of
any size are the same on any number of partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = (("Россия", 4), ("EMEA", 3), ("Азия", 2), ("Америка", 2))
PLANS = (("Enterprise", 1, 900), ("Business", 2, 420), ("Team", 4, 160), ("Starter", 5, 60))
CHANNELS = (("Прямой", 4), ("Реклама", 3), ("Партнёры", 2), ("Рекомендации", 2))
CITIES = (("Москва", 6), ("Петербург", 4), ("Казань", 2), ("Екатеринбург", 2), ("Новосибирск", 2), ("Самара", 1))
CATEGORIES = (("Электроника", 3, 11000), ("Одежда", 4, 1200), ("Дом", 3, 1800), ("Книги", 4, 900), ("Спорт", 2, 2200), ("Игрушки", 3, 1300))
DELIVERY = (("Курьер", 5), ("Пункт выдачи", 4), ("Почта", 2), ("Постамат", 2))


def uniform(seed: int, name: str) -> Column:
    """In (0, 1), by row ``id``."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(seed: int, name: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, name + "1"))) * F.cos(2 * math.pi * uniform(seed, name + "2"))


def pick(u: Column, options) -> Column:
    total, run = sum(o[1] for o in options), 0.0
    out = F.lit(options[-1][0])
    for o in reversed(options[:-1]):
        run = sum(x[1] for x in options[: options.index(o) + 1])
        out = F.when(u < run / total, F.lit(o[0])).otherwise(out)
    return out


def lookup(c: Column, options, k: int) -> Column:
    out = F.lit(float(options[-1][k]))
    for o in options[:-1]:
        out = F.when(c == o[0], F.lit(float(o[k]))).otherwise(out)
    return out


def saas(spark: SparkSession, days: int = 400, a_day: int = 12, seed: int = 20260726) -> DataFrame:
    """Subscriptions: growth with a weekday cycle, one weak week (250-256), EMEA
    revenue down after day 210, more churn through partners, 18 repeated rows."""
    r = spark.range(days * a_day).withColumn("day", F.floor(F.col("id") / a_day).cast("int"))
    u = lambda n: uniform(seed, n)
    r = r.withColumns({"region": pick(u("region"), REGIONS), "plan": pick(u("plan"), PLANS), "channel": pick(u("channel"), CHANNELS)})
    season = F.when((F.col("day") % 7).isin(5, 6), 0.7).otherwise(1.05)
    share = season * F.least(F.lit(1.0), F.lit(0.45) + 0.55 * F.col("day") / days) * F.when(F.col("day").between(250, 256), 0.25).otherwise(1.0)
    kept = r.where((u("keep") < share) | (F.col("id") < 40))
    partner = F.col("channel") == "Партнёры"
    seats = F.greatest(F.lit(1), F.round(F.exp(1.6 + 0.8 * normal(seed, "seats")))).cast("int")
    mrr = lookup(F.col("plan"), PLANS, 2) * (1 + 0.0009 * F.col("day")) * F.exp(0.18 * normal(seed, "mrr")) * F.when((F.col("region") == "EMEA") & (F.col("day") > 210), 0.42).otherwise(1.0)
    rows = kept.select(
        F.format_string("SUB-%06d", F.col("id") + 1).alias("subscription_id"), F.date_add(F.lit("2025-01-06").cast("date"), F.col("day")).cast("string").alias("date"), "region", "plan", "channel",
        F.round(mrr).cast("int").cast("string").alias("mrr"), seats.cast("string").alias("seats"),
        F.when(u("churn") < F.when(partner, 0.19).otherwise(0.06), "да").otherwise("нет").alias("churned"),
        F.when(u("gap") >= 0.04, F.floor(-2.2 * F.log(u("tickets"))).cast("int").cast("string")).alias("support_tickets"),
        F.round(F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.when(partner, 6.4).otherwise(7.9) + 1.1 * normal(seed, "score"))), 1).cast("string").alias("satisfaction_score"), "id",
    )
    again = rows.where((F.col("id") < 36) & (F.col("id") % 2 == 0))
    return rows.unionAll(again).drop("id")


def retail(spark: SparkSession, days: int = 300, a_day: int = 14, seed: int = 19042026) -> DataFrame:
    """Orders: revenue concentrated in one category, value tied to the number of
    items, mail with many returns and slow delivery, drifting shipping cost, and
    one order a hundred times too large."""
    r = spark.range(days * a_day).withColumn("day", F.floor(F.col("id") / a_day).cast("int"))
    u = lambda n: uniform(seed, n)
    r = r.withColumns({"city": pick(u("city"), CITIES), "category": pick(u("category"), CATEGORIES), "delivery_method": pick(u("delivery"), DELIVERY), "items": F.greatest(F.lit(1), F.round(1.4 - 1.9 * F.log(u("items")))).cast("int")})
    odd = F.col("id") == days * a_day // 2
    r = r.withColumns({"category": F.when(odd, "Книги").otherwise(F.col("category")), "items": F.when(odd, 2).otherwise(F.col("items"))})
    mail, point = F.col("delivery_method") == "Почта", F.col("delivery_method") == "Пункт выдачи"
    value = lookup(F.col("category"), CATEGORIES, 2) * F.col("items") * F.exp(0.25 * normal(seed, "value")) * F.when(odd, 100).otherwise(1)
    return r.select(
        F.format_string("ORD-%06d", F.col("id") + 1).alias("order_id"), F.date_add(F.lit("2025-06-01").cast("date"), F.col("day")).cast("string").alias("order_date"), "city", "category", "delivery_method",
        F.round(value).cast("long").cast("string").alias("order_value"), F.col("items").cast("string").alias("items_count"),
        F.when(point, 0).otherwise(F.round(290 * (1 + 0.0016 * F.col("day")) * F.exp(0.1 * normal(seed, "ship")))).cast("int").cast("string").alias("shipping_cost"),
        F.greatest(F.lit(1), F.round(F.when(mail, 9.5).otherwise(3.2) + 1.3 * normal(seed, "days"))).cast("int").cast("string").alias("delivery_days"),
        F.when(u("returned") < F.when(mail, 0.24).otherwise(0.07), "да").otherwise("нет").alias("returned"),
    )


def noise(spark: SparkSession, days: int = 399, a_day: int = 3, seed: int = 12345) -> DataFrame:
    """Nothing but uniform noise on three dimensions and four measures, in whole weeks."""
    r = spark.range(days * a_day)
    u = lambda n: uniform(seed, n)
    part = lambda name, n: F.concat(F.lit(name), (F.floor(u(name) * n) + 1).cast("string")).alias(name)
    return r.select(
        F.date_add(F.lit("2025-01-06").cast("date"), F.floor(F.col("id") / a_day).cast("int")).cast("string").alias("date"), part("segment", 4), part("region", 7), part("tier", 5),
        *[F.round(100 * u(f"value_{k}"), 2).cast("string").alias(f"value_{k}") for k in "abcd"],
    )


SAMPLES = {"saas": saas, "retail": retail}
