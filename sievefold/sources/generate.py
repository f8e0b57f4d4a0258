"""Seeded demo tables of a credit schema; every value is a hash of its key, so partitions don't matter."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns a row's key, a name and a seed into a column.
Maker = Callable[[Column, str, int], Column]


def unit(key: Column, name: str, seed: int) -> Column:
    """Uniform in [0, 1)."""
    return F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def gaussian(key: Column, name: str, seed: int) -> Column:
    u, v = F.greatest(unit(key, f"{name}:u", seed), F.lit(1e-12)), unit(key, f"{name}:v", seed)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def integer(low: int, high: int) -> Maker:
    """low .. high - 1."""
    return lambda k, n, s: (F.floor(unit(k, n, s) * (high - low)) + low).cast("int")


def uniform(low: float, high: float) -> Maker:
    return lambda k, n, s: low + unit(k, n, s) * (high - low)


def normal(mean: float, deviation: float, least: float) -> Maker:
    return lambda k, n, s: F.greatest(mean + deviation * gaussian(k, n, s), F.lit(float(least)))


def lognormal(mean: float, deviation: float) -> Maker:
    return lambda k, n, s: F.exp(mean + deviation * gaussian(k, n, s)).cast("long")


def exponential(scale: float) -> Maker:
    return lambda k, n, s: -scale * F.log(1 - unit(k, n, s))


def whole(maker: Maker) -> Maker:
    return lambda k, n, s: maker(k, n, s).cast("int")


def poisson(mean: float, plus: int = 0) -> Maker:
    """The number of steps of the distribution function that a uniform value is past."""
    steps, at, term = [], 0.0, math.exp(-mean)
    for k in range(int(mean + 12 * math.sqrt(mean) + 12)):
        at += term
        steps.append(at)
        term *= mean / (k + 1)
    return lambda k, n, s: (F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x < unit(k, n, s))) + plus).cast("int")


def choice(values: Sequence, weights: Sequence[float] | None = None) -> Maker:
    """One of the values, with the given probabilities or equal ones."""
    weights = weights or [1 / len(values)] * len(values)

    def make(k: Column, n: str, s: int) -> Column:
        u, at, out = unit(k, n, s), 0.0, None
        for value, w in zip(values[:-1], weights, strict=False):
            at += w
            out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
        return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))

    return make


def flag(share: float) -> Maker:
    return choice((0, 1), (1 - share, share))


# Names, categories, probabilities and distributions of the demo tables' columns.
APPLICATION: dict[str, Maker] = {
    "TARGET": flag(0.2),
    "NAME_CONTRACT_TYPE": choice(("Cash loans", "Revolving loans"), (0.9, 0.1)),
    "CODE_GENDER": choice(("M", "F"), (0.6, 0.4)),
    "FLAG_OWN_CAR": choice(("Y", "N"), (0.4, 0.6)),
    "FLAG_OWN_REALTY": choice(("Y", "N"), (0.7, 0.3)),
    "CNT_CHILDREN": choice((0, 1, 2, 3, 4, 5), (0.4, 0.3, 0.2, 0.05, 0.03, 0.02)),
    "AMT_INCOME_TOTAL": lognormal(10.5, 0.8),
    "AMT_CREDIT": lognormal(11.8, 0.6),
    "AMT_ANNUITY": whole(normal(25_000, 15_000, 5_000)),
    "AMT_GOODS_PRICE": lognormal(11.5, 0.7),
    "NAME_INCOME_TYPE": choice(("Working", "Commercial associate", "Pensioner", "State servant", "Student"), (0.5, 0.2, 0.15, 0.1, 0.05)),
    "NAME_EDUCATION_TYPE": choice(("Secondary / secondary special", "Higher education", "Incomplete higher", "Lower secondary"), (0.6, 0.25, 0.1, 0.05)),
    "NAME_FAMILY_STATUS": choice(("Married", "Single / not married", "Civil marriage", "Separated", "Widow"), (0.4, 0.3, 0.15, 0.1, 0.05)),
    "NAME_HOUSING_TYPE": choice(("House / apartment", "With parents", "Municipal apartment", "Rented apartment", "Office apartment"), (0.5, 0.2, 0.15, 0.1, 0.05)),
    "DAYS_BIRTH": integer(1 - 70 * 365, 1 - 18 * 365),
    "DAYS_EMPLOYED": integer(1 - 40 * 365, 1),
    "FLAG_MOBIL": flag(0.9),
    "FLAG_EMP_PHONE": flag(0.8),
    "FLAG_WORK_PHONE": flag(0.7),
    "FLAG_CONT_MOBILE": flag(0.95),
    "FLAG_PHONE": flag(0.6),
    "FLAG_EMAIL": flag(0.7),
    "REGION_RATING_CLIENT": choice((1, 2, 3), (0.3, 0.5, 0.2)),
    "HOUR_APPR_PROCESS_START": integer(0, 24),
    "REG_REGION_NOT_LIVE_REGION": flag(0.1),
    "REG_REGION_NOT_WORK_REGION": flag(0.2),
    "LIVE_REGION_NOT_WORK_REGION": flag(0.15),
}
BUREAU: dict[str, Maker] = {
    "CREDIT_ACTIVE": choice(("Active", "Closed", "Bad debt", "Sold"), (0.4, 0.5, 0.05, 0.05)),
    "CREDIT_CURRENCY": choice(("currency 1",)),
    "DAYS_CREDIT": integer(1 - 10 * 365, 1),
    "CREDIT_DAY_OVERDUE": normal(0, 50, 0),
    "DAYS_CREDIT_ENDDATE": integer(-5 * 365, 10 * 365),
    "DAYS_ENDDATE_FACT": integer(-5 * 365, 10 * 365),
    "AMT_CREDIT_MAX_OVERDUE": exponential(50_000),
    "CNT_CREDIT_PROLONG": poisson(0.5),
    "AMT_CREDIT_SUM": lognormal(11, 1),
    "AMT_CREDIT_SUM_DEBT": lognormal(10, 1.5),
    "AMT_CREDIT_SUM_LIMIT": lognormal(11.5, 1.2),
    "AMT_CREDIT_SUM_OVERDUE": exponential(10_000),
    "CREDIT_TYPE": choice(("Consumer credit", "Credit card", "Mortgage", "Car loan", "Microloan"), (0.3, 0.25, 0.2, 0.15, 0.1)),
    "DAYS_CREDIT_UPDATE": integer(1 - 365, 1),
    "AMT_ANNUITY": lognormal(9, 1),
}
PREVIOUS: dict[str, Maker] = {
    "NAME_CONTRACT_TYPE": choice(("Consumer loans", "Cash loans", "Revolving loans"), (0.5, 0.4, 0.1)),
    "AMT_ANNUITY": lognormal(10, 0.8),
    "AMT_APPLICATION": lognormal(12, 0.7),
    "AMT_CREDIT": lognormal(11.5, 0.8),
    "AMT_DOWN_PAYMENT": whole(exponential(50_000)),
    "AMT_GOODS_PRICE": lognormal(11.8, 0.9),
    "WEEKDAY_APPR_PROCESS_START": choice(("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")),
    "HOUR_APPR_PROCESS_START": integer(0, 24),
    "FLAG_LAST_APPL_PER_CONTRACT": choice(("Y", "N"), (0.8, 0.2)),
    "NAME_CASH_LOAN_PURPOSE": choice(("XAP", "XNA", "Repairs", "Other", "Education", "Furniture", "Business development"), (0.3, 0.2, 0.15, 0.1, 0.1, 0.1, 0.05)),
    "NAME_CONTRACT_STATUS": choice(("Approved", "Canceled", "Refused", "Unused offer"), (0.6, 0.2, 0.15, 0.05)),
    "DAYS_DECISION": integer(1 - 5 * 365, -29),
    "NAME_PAYMENT_TYPE": choice(("Cash through the bank", "XNA", "Non-cash from your account"), (0.4, 0.4, 0.2)),
    "CODE_REJECT_REASON": choice(("XAP", "HC", "LIMIT", "SCO", "CLIENT", "SYSTEM", "XNA"), (0.7, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02)),
    "NAME_TYPE_SUITE": choice(("Unaccompanied", "With spouse", "Family", "Other_B", "Other_A", "Group of people"), (0.6, 0.15, 0.1, 0.05, 0.05, 0.05)),
    "NAME_CLIENT_TYPE": choice(("Repeater", "New", "Refreshed", "XNA"), (0.4, 0.35, 0.2, 0.05)),
    "NAME_GOODS_CATEGORY": choice(("XNA", "Mobile", "Computers", "Photo / Cinema Equipment", "Consumer Electronics", "Furniture"), (0.4, 0.2, 0.15, 0.1, 0.1, 0.05)),
    "NAME_PORTFOLIO": choice(("POS", "Cash", "Cards", "XNA"), (0.4, 0.3, 0.25, 0.05)),
    "NAME_PRODUCT_TYPE": choice(("XNA", "walk-in", "x-sell"), (0.6, 0.3, 0.1)),
    "CHANNEL_TYPE": choice(("Credit and cash offices", "Country-wide", "Stone", "Regional / Local", "Contact center", "Car dealer"), (0.3, 0.25, 0.2, 0.1, 0.1, 0.05)),
}
CARD: dict[str, Maker] = {
    "AMT_BALANCE": normal(50_000, 30_000, 0),
    "AMT_CREDIT_LIMIT_ACTUAL": uniform(50_000, 500_000),
    "AMT_DRAWINGS_ATM_CURRENT": exponential(5_000),
    "AMT_DRAWINGS_CURRENT": exponential(10_000),
    "AMT_DRAWINGS_OTHER_CURRENT": exponential(3_000),
    "AMT_DRAWINGS_POS_CURRENT": exponential(8_000),
    "AMT_INST_MIN_REGULARITY": normal(2_000, 1_000, 0),
    "AMT_PAYMENT_CURRENT": normal(15_000, 10_000, 0),
    "AMT_PAYMENT_TOTAL_CURRENT": normal(18_000, 12_000, 0),
    "AMT_RECEIVABLE_PRINCIPAL": normal(30_000, 20_000, 0),
    "AMT_RECIVABLE": normal(32_000, 22_000, 0),
    "AMT_TOTAL_RECEIVABLE": normal(35_000, 25_000, 0),
    "CNT_DRAWINGS_ATM_CURRENT": poisson(2),
    "CNT_DRAWINGS_CURRENT": poisson(5),
    "CNT_DRAWINGS_OTHER_CURRENT": poisson(1),
    "CNT_DRAWINGS_POS_CURRENT": poisson(8),
    "CNT_INSTALMENT_MATURE_CUM": lambda k, n, s: F.greatest(F.lit(0), F.round(F.col("n") + F.sqrt("n") * gaussian(k, n, s))).cast("int"),
    "NAME_CONTRACT_STATUS": choice(("Active", "Completed", "Demand", "Refused", "Approved", "Cancelled", "Signed"), (0.6, 0.15, 0.1, 0.05, 0.05, 0.03, 0.02)),
    "SK_DPD": whole(exponential(2)),
    "SK_DPD_DEF": whole(exponential(1)),
}


def _made(key: Column, columns: dict[str, Maker], table: str, seed: int) -> list[Column]:
    return [make(key, f"{table}:{name}", seed).alias(name) for name, make in columns.items()]


def _ids(spark: SparkSession, n: int, of: int, table: str, seed: int) -> DataFrame:
    """n of the first ``of`` application ids, those with the least hash."""
    every = spark.range(of).select((F.col("id") + 100_000).alias("SK_ID_CURR"))
    return every.orderBy(F.xxhash64("SK_ID_CURR", F.lit(table), F.lit(seed)), "SK_ID_CURR").limit(n) if n < of else every


def _many(spark: SparkSession, ids: int, count: Maker, table: str, seed: int) -> DataFrame:
    """One-to-many rows: (SK_ID_CURR, n), n from 1."""
    df = _ids(spark, ids, max(ids, 500), table, seed)
    return df.select("SK_ID_CURR", F.explode(F.sequence(F.lit(1), count(F.col("SK_ID_CURR"), table, seed))).alias("n"))


def application(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """X1."""
    return _ids(spark, n, n, "application", seed).select("SK_ID_CURR", *_made(F.col("SK_ID_CURR"), APPLICATION, "application", seed))


def bureau(spark: SparkSession, ids: int = 350, seed: int = 42) -> DataFrame:
    """Poisson(2) + 1 rows for each id."""
    df = _many(spark, ids, poisson(2, 1), "bureau", seed)
    return df.select("SK_ID_CURR", (F.col("SK_ID_CURR") * 1000 + F.col("n") - 1).alias("SK_ID_BUREAU"), *_made(F.xxhash64("SK_ID_CURR", "n"), BUREAU, "bureau", seed))


def previous_application(spark: SparkSession, ids: int = 300, seed: int = 42) -> DataFrame:
    """Poisson(1.5) + 1 rows for each id."""
    df = _many(spark, ids, poisson(1.5, 1), "previous", seed)
    return df.select("SK_ID_CURR", (F.col("SK_ID_CURR") * 100 + F.col("n") - 1).alias("SK_ID_PREV"), *_made(F.xxhash64("SK_ID_CURR", "n"), PREVIOUS, "previous", seed))


def credit_card_balance(spark: SparkSession, ids: int = 200, seed: int = 42) -> DataFrame:
    """Months count down from -1."""
    df = _many(spark, ids, integer(6, 36), "card", seed)
    prev = (F.col("SK_ID_CURR") * 10 + (F.col("n") - 1) % 10).alias("SK_ID_PREV")
    return df.select("SK_ID_CURR", prev, (-F.col("n")).alias("MONTHS_BALANCE"), *_made(F.xxhash64("SK_ID_CURR", "n"), CARD, "card", seed))


def installments(spark: SparkSession, ids: int = 400, seed: int = 42) -> DataFrame:
    """X5."""
    k = F.xxhash64("SK_ID_CURR", "n", F.lit("installments"))
    df = _many(spark, ids, integer(12, 120), "installments", seed)
    due = lognormal(9, 0.5)(k, "AMT", seed).cast("double")
    prev = (F.col("SK_ID_CURR") * 10 + (F.col("n") - 1) % 10).alias("SK_ID_PREV")
    version = choice((0, 1, 2), (0.8, 0.15, 0.05))(k, "VERSION", seed).alias("NUM_INSTALMENT_VERSION")
    return df.select("SK_ID_CURR", prev, version, F.col("n").alias("NUM_INSTALMENT_NUMBER"), (-30 * F.col("n")).alias("DAYS_INSTALMENT"), (-30 * F.col("n") + integer(-5, 15)(k, "LATE", seed)).alias("DAYS_ENTRY_PAYMENT"), due.alias("AMT_INSTALMENT"), F.round(due * (0.9 + 0.1 * unit(k, "PAID", seed)), 2).alias("AMT_PAYMENT"))


def pos_cash(spark: SparkSession, ids: int = 250, seed: int = 42) -> DataFrame:
    """X6."""
    k = F.xxhash64("SK_ID_CURR", "n", F.lit("pos"))
    df = _many(spark, ids, integer(6, 48), "pos", seed)
    columns = {"CNT_INSTALMENT": integer(6, 60), "CNT_INSTALMENT_FUTURE": integer(0, 50), "NAME_CONTRACT_STATUS": choice(("Active", "Completed", "Signed")), "SK_DPD": whole(exponential(3)), "SK_DPD_DEF": whole(exponential(1.5))}
    prev = (F.col("SK_ID_CURR") * 10 + (F.col("n") - 1) % 10).alias("SK_ID_PREV")
    return df.select("SK_ID_CURR", prev, (-F.col("n")).alias("MONTHS_BALANCE"), *_made(k, columns, "pos", seed))


TABLES = {"application_main": application, "bureau": bureau, "previous_application": previous_application, "credit_card_balance": credit_card_balance, "installments_payments": installments, "POS_CASH_balance": pos_cash}
KEYS = {"application_main": ["SK_ID_CURR"], "bureau": ["SK_ID_BUREAU"], "previous_application": ["SK_ID_PREV"], "credit_card_balance": ["SK_ID_CURR", "MONTHS_BALANCE"], "installments_payments": ["SK_ID_CURR", "NUM_INSTALMENT_NUMBER"], "POS_CASH_balance": ["SK_ID_CURR", "MONTHS_BALANCE"]}


def all_tables(spark: SparkSession, seed: int = 42) -> dict[str, DataFrame]:
    return {name: make(spark, seed=seed) for name, make in TABLES.items()}


def composer_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Three tables of five rows with nulls, keyed by the same ids, for use where a folder has no data."""
    main = [(100_001 + k, t, income, a, b, c) for k, (t, income, a, b, c) in enumerate([("Cash loans", 150_000.0, 0.1, 0.3, 0.2), ("Cash loans", 240_000.0, None, 0.6, None), ("Revolving loans", 60_000.0, 0.3, None, 0.7), ("Cash loans", 130_000.0, 0.6, 0.5, None), ("Cash loans", 120_000.0, None, 0.7, None)])]
    balance = [(5_001 + k, 100_001 + k, -1 - k, s) for k, s in enumerate("C0XC0")]
    previous = [(2_000_001 + k, 100_001 + k, a, s) for k, (a, s) in enumerate([(25_000.0, "Approved"), (180_000.0, "Approved"), (20_000.0, "Approved"), (47_000.0, "Refused"), (67_000.0, "Approved")])]
    return {
        "application_main": spark.createDataFrame(main, "SK_ID_CURR long, NAME_CONTRACT_TYPE string, AMT_INCOME_TOTAL double, EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double"),
        "bureau_balance": spark.createDataFrame(balance, "SK_ID_BUREAU long, SK_ID_CURR long, MONTHS_BALANCE int, STATUS string"),
        "previous_application": spark.createDataFrame(previous, "SK_ID_PREV long, SK_ID_CURR long, AMT_APPLICATION double, NAME_CONTRACT_STATUS string"),
    }
