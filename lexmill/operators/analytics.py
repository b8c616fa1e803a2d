"""Deterministic analytics: tax calculators, obligations, validity of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import rules
from lexmill.functions.staging import hint_if_small


def _rate(category: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), category)


def household_tax(revenue: Column, category: Column) -> Column:
    """Tax of a household business by shares of revenue: struct, with ``error`` for bad input.

    VAT has no threshold; income tax is on the whole revenue once it is above the
    exempt amount.
    """
    vat, pit = _rate(category, rules.VAT_RATES), _rate(category, rules.PIT_RATES)
    exempt = revenue <= rules.EXEMPT_UP_TO
    due_vat, due_pit = revenue * vat, F.when(exempt, F.lit(0.0)).otherwise(revenue * pit)
    error = F.when(revenue.isNull() | (revenue < 0), "negative revenue").when(vat.isNull(), "unknown category")
    ok = lambda c: F.when(error.isNull(), c)
    return F.struct(
        ok(exempt).alias("exempt"),
        ok(vat).alias("gtgt_rate"),
        ok(F.bround(due_vat).cast("long")).alias("gtgt_payable"),
        ok(F.when(exempt, F.lit(0.0)).otherwise(pit)).alias("tncn_rate"),
        ok(F.bround(due_pit).cast("long")).alias("tncn_payable"),
        ok(F.bround(due_vat + due_pit).cast("long")).alias("total_tax"),
        ok(revenue > rules.PROFIT_FROM).alias("must_use_profit"),
        error.alias("error"),
    )


def bracket_table(spark: SparkSession, rows: list[tuple[float, float | None, float]]) -> DataFrame:
    """Brackets (lo, hi, rate); the last one is open."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "bracket int, lo double, hi double, rate double").coalesce(1)


def with_profit_rate(rows: DataFrame, revenue: str = "revenue") -> DataFrame:
    """The profit method's rate by a range join with its few brackets: above lo, up to hi."""
    table = F.broadcast(bracket_table(rows.sparkSession, rules.PROFIT_BRACKETS).select("lo", "hi", F.col("rate").alias("profit_rate")))  # four rows
    inside = (F.col(revenue) > F.col("lo")) & (F.col("hi").isNull() | (F.col(revenue) <= F.col("hi")))
    return rows.join(table, inside, "left").withColumn("profit_rate", F.coalesce("profit_rate", F.lit(rules.PROFIT_BRACKETS[-1][2]))).drop("lo", "hi")


def profit_tax(revenue: Column, expenses: Column, category: Column, profit_rate: Column) -> Column:
    """Tax by the profit method; revenue must be above the exempt amount and expenses below revenue."""
    vat = _rate(category, rules.VAT_RATES)
    error = (
        F.when(vat.isNull(), "unknown category")
        .when(revenue <= rules.EXEMPT_UP_TO, "revenue is exempt")
        .when(expenses < 0, "negative expenses")
        .when(expenses >= revenue, "expenses reach revenue")
    )
    ok = lambda c: F.when(error.isNull(), c)
    due_vat, due_pit = F.bround(revenue * vat).cast("long"), F.bround((revenue - expenses) * profit_rate).cast("long")
    return F.struct(
        ok(revenue - expenses).alias("profit"),
        ok(F.bround((revenue - expenses) / revenue, 4)).alias("margin"),
        ok(due_vat).alias("gtgt_payable"),
        ok(due_pit).alias("tncn_payable"),
        ok(due_vat + due_pit).alias("total_tax"),
        error.alias("error"),
    )


def progressive_slices(rows: DataFrame, income: str = "income") -> DataFrame:
    """A row for each bracket that an income reaches, with its slice and tax: an overlap join with five brackets."""
    table = F.broadcast(bracket_table(rows.sparkSession, rules.INCOME_BRACKETS))
    part = F.least(F.col(income), F.coalesce("hi", F.col(income))) - F.col("lo")
    return rows.join(table, F.col(income) > F.col("lo")).withColumn("slice", part).withColumn("slice_tax", part * F.col("rate")).drop("lo", "hi")


def progressive_tax(income: Column) -> Column:
    """Yearly progressive tax of an income in one expression; null for a negative one."""
    parts = [F.when(income > lo, (income if hi is None else F.least(income, F.lit(hi))) - lo).otherwise(F.lit(0.0)) * rate for lo, hi, rate in rules.INCOME_BRACKETS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(income >= 0, total)


def deduction(dependents: Column, months: Column) -> Column:
    """Deductions of a taxpayer with dependants over some months, now and under the former amounts."""
    monthly = F.lit(rules.SELF_DEDUCTION) + rules.DEPENDENT_DEDUCTION * dependents
    old = F.lit(rules.OLD_SELF_DEDUCTION) + rules.OLD_DEPENDENT_DEDUCTION * dependents
    error = F.when(dependents < 0, "negative dependents").when(~months.between(1, 12), "months out of range")
    ok = lambda c: F.when(error.isNull(), c.cast("long"))
    return F.struct(ok(monthly).alias("monthly"), ok(monthly * months).alias("annual"), ok(old * months).alias("old_annual"), ok((monthly - old) * months).alias("gain"), error.alias("error"))


def obligation(revenue: Column, online: Column, platform_pays: Column) -> Column:
    """What a business has to do by revenue and way of selling."""
    exempt = revenue <= rules.EXEMPT_UP_TO
    method = F.when(exempt, "none").when(revenue <= rules.PROFIT_FROM, "either").otherwise("profit")
    filing = F.when(exempt, "exempt").when(revenue <= rules.MONTHLY_FROM, "quarterly").otherwise("monthly")
    invoice = F.when(revenue < rules.EINVOICE_OPTIONAL, "false").when(revenue < rules.EINVOICE_REQUIRED, "optional").otherwise("true")
    rate = F.when(method == "profit", F.when(revenue <= rules.MONTHLY_FROM, 0.17).otherwise(0.20))
    withheld = online & platform_pays
    kinds = [
        (exempt, "exempt"),
        (method == "either", "choose_method"),
        (method == "profit", "profit_method"),
        (~exempt, "file_vat"),
        (invoice == "optional", "einvoice_optional"),
        (invoice == "true", "einvoice_required"),
        (withheld, "platform_withholds"),
        (online & ~platform_pays, "declare_online_sales"),
    ]
    duties = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in kinds]), lambda x: x.isNotNull())
    return F.when(
        revenue >= 0,
        F.struct(
            exempt.alias("is_exempt"), method.alias("tax_method"), rate.alias("profit_rate"), filing.alias("filing"), invoice.alias("einvoice"), withheld.alias("withholding"), duties.alias("obligations")
        ),
    )


def validity(asked: DataFrame, manifest: DataFrame, missing: DataFrame, as_of: Column) -> DataFrame:
    """Validity of asked documents: in the manifest, known to be missing, or unknown.

    An active document is valid whatever its dates; one that is active until it is
    superseded is valid up to its end.
    """
    m = manifest.select("doc_id", F.lit(True).alias("found"), "status", "effective_from", "effective_to", "name", "note", "superseded_by")
    n = missing.select("doc_id", F.col("name").alias("n_name"), F.col("note").alias("n_note"), F.lit(True).alias("known"))
    both = asked.join(hint_if_small(m, 256), "doc_id", "left").join(hint_if_small(n, 256), "doc_id", "left")
    valid = F.when(F.col("status") == "active", True).when(F.col("status") == "active_until_superseded", F.col("effective_to").isNull() | (as_of <= F.col("effective_to"))).otherwise(False)
    return both.select(
        *asked.columns,
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("status", F.when(F.col("known"), F.lit("not_in_database")), F.lit("unknown")).alias("status"),
        F.coalesce(valid, F.lit(False)).alias("is_currently_valid"),
        "effective_from",
        "effective_to",
        F.coalesce("name", "n_name", "doc_id").alias("name"),
        F.coalesce("note", "n_note", F.lit("")).alias("note"),
        "superseded_by",
    )


def pending_citations(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Answers that cite, by number and year, documents not yet in force: (answer_id, doc_id)."""
    pending = manifest.where("status = 'pending'").select("doc_id", F.regexp_extract("doc_number", r"^(\d+/\d{4})", 1).alias("no")).where("no <> ''")
    text = F.concat(F.lit(" "), F.col("answer"), F.lit(" "))
    return answers.join(hint_if_small(pending, 64), F.regexp_like(text, F.concat(F.lit(r"[^\p{L}\p{N}_]"), F.col("no"), F.lit(r"[^\p{L}\p{N}_]")))).select("answer_id", "doc_id")


def law_section(manifest: DataFrame) -> DataFrame:
    """Lines of a report on the law: active documents, superseded ones with their successors, exceptions."""
    names = manifest.select(F.col("doc_id").alias("superseded_by"), F.col("doc_number").alias("successor"))
    both = manifest.join(names, "superseded_by", "left")
    kind = F.when(F.col("status").startswith("active"), 1).otherwise(2)
    text = F.when(kind == 1, F.concat_ws(" ", "doc_number", F.concat(F.lit("("), "name", F.lit(")")))).otherwise(F.concat_ws(" ", "doc_number", F.lit("→"), F.coalesce("successor", "superseded_by", F.lit("?"))))
    return both.select(kind.alias("section"), "doc_id", text.alias("line"))


def resolve_conflict(rows: DataFrame, group: str) -> DataFrame:
    """Of conflicting documents, the one of highest rank (lowest level), the first of equals: rows (group, doc_id, legal_level, seq)."""
    return rows.groupBy(group).agg(F.min_by("doc_id", F.struct(F.coalesce("legal_level", F.lit(99)), "seq")).alias("winner"))


def effective_on(registry: DataFrame, day: Column) -> DataFrame:
    return registry.where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day)))


def chunk_conflicts(pairs: DataFrame) -> DataFrame:
    """Winner of each conflicting pair: higher rank, then newer, then the first: pairs (a_id, a_level, a_date, b_id, b_level, b_date)."""
    first = (F.col("a_level") < F.col("b_level")) | ((F.col("a_level") == F.col("b_level")) & (F.col("a_date") >= F.col("b_date")))
    return pairs.select("*", F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("winner"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("loser"))


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key: an idempotent upsert is the union of old and new rows, cut down to this."""
    return rows.withColumn("n__", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).where("n__ = 1").drop("n__")


def by_category(registry: DataFrame, category: str) -> DataFrame:
    """Registered documents of a category, the highest rank first by ``legal_level``: (…, place)."""
    return registry.where(F.col("category") == category).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("legal_level", "doc_id")))


def registry_list(registry: DataFrame) -> DataFrame:
    """Documents as they are listed: active if they have a date of effect."""
    return registry.select("doc_id", "name", F.when(F.col("effective_from").isNotNull(), "active").otherwise("unknown").alias("status"))
