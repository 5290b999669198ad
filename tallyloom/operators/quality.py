"""Record rules in six dimensions, rejects, scores and grades."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.fixed import COUNTRIES, CURRENCIES, GRADES, MISSING, PENALTIES, WEIGHTS
from tallyloom.functions.lineage import in_methods, written
from tallyloom.functions.text import changed_keys, is_blank, is_rule_date, is_rule_email, iso_date, trim

KEYS = ["source_id", "job_id", "row_number"]
DUPLICATE = "UNIQUENESS_DUPLICATE_HASH"


@dataclass(frozen=True)
class Rule:
    """Fires on a record when ``condition`` holds (null: doesn't); ``message`` may use the same columns."""

    code: str
    dimension: str
    severity: str
    field: str
    condition: Column
    message: Column


class Record:
    """The fields of a payload that rules ask for, as columns of their own: ``laid_out`` takes each out of the payload once, however many
    rules use it. Blank values are null in them, which is tested once for each field and not for each rule."""

    def __init__(self) -> None:
        self.plain: dict[str, str] = {}
        self.any: dict[str, str] = {}

    def __getitem__(self, name: str) -> Column:
        return F.col(self.plain.setdefault(name, f"_f{len(self.plain)}"))

    def spelt(self, name: str) -> Column:
        """The first value whose key is ``name`` in lower case with spaces and dashes as underscores."""
        return F.col(self.any.setdefault(name, f"_s{len(self.any)}"))

    def laid_out(self, staged: DataFrame) -> DataFrame:
        keys = changed_keys("payload", lambda k: F.replace(F.replace(F.lower(k), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")))
        rows = staged.withColumn("_keys", keys) if self.any else staged
        fields = [F.col("payload")[name].alias(c) for name, c in self.plain.items()]
        first = lambda name: F.get(F.map_values("payload"), (F.array_position("_keys", name) - 1).cast("int"))
        spelt = [first(name).alias(c) for name, c in self.any.items()]
        some = [F.when(~is_blank(F.col(c)), F.col(c)).alias(c) for c in (*self.plain.values(), *self.any.values())]
        return in_methods(in_methods(rows, "row_number", *staged.columns, *fields, *spelt), "row_number", *staged.columns, *some)


def _first(p: Record, names: list[str]) -> Column:
    """The first of several fields that is there."""
    return F.coalesce(*[p[n] for n in names])


def _says(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def completeness(p: Record) -> list[Rule]:
    needed = {
        "customer_name": ("COMPLETENESS_CUSTOMER_NAME", ["customer_name", "Customer Name", "name"]),
        "total_amount": ("COMPLETENESS_TOTAL_AMOUNT", ["total_amount", "Sales", "amount"]),
        "sku": ("COMPLETENESS_SKU", ["sku", "product_sku", "product_code"]),
    }
    return [Rule(code, "COMPLETENESS", "CRITICAL", f, _first(p, names).isNull(), F.lit(MISSING.format(f))) for f, (code, names) in needed.items()]


def validity(p: Record) -> list[Rule]:
    rules = []

    def add(code: str, field: str, condition: Column, message: Column) -> None:
        rules.append(Rule(code, "VALIDITY", "HIGH", field, p[field].isNotNull() & condition, message))

    for f in ("order_date", "Order Date", "ship_date", "Ship Date"):
        add("VALIDITY_DATE_FORMAT", f, ~is_rule_date(p[f]), _says(f"{f}: '", p[f], "' fits no date format"))
    for f in ("total_amount", "Sales", "quantity", "unit_price", "shipping_cost", "Shipping Cost"):
        number = p[f].try_cast("double")
        add("VALIDITY_NEGATIVE_NUMBER", f, number < 0, _says(f"{f}: ", p[f], " is below zero"))
        add("VALIDITY_NON_NUMERIC", f, number.isNull(), _says(f"{f}: '", p[f], "' is no number"))
    for f in ("email", "email_address", "contact_email"):
        add("VALIDITY_EMAIL_FORMAT", f, ~is_rule_email(p[f]), _says(f"{f}: '", p[f], "' is no email address"))
    return rules


def uniqueness(copies: Column) -> list[Rule]:
    return [Rule(DUPLICATE, "UNIQUENESS", "HIGH", "record_hash", copies > 1, F.lit("Another record of the source has the same content"))]


def consistency(p: Record, as_of: Column) -> list[Rule]:
    q, u, t = (p[f].try_cast("double") for f in ("quantity", "unit_price", "line_total"))
    date = iso_date(_first(p, ["order_date", "Order Date"]))
    return [
        Rule("CONSISTENCY_LINE_TOTAL", "CONSISTENCY", "MEDIUM", "line_total", F.abs(q * u - t) > 0.01, F.format_string("line_total %.4f differs from quantity * unit_price %.4f", t, q * u)),
        Rule("CONSISTENCY_FUTURE_ORDER_DATE", "CONSISTENCY", "MEDIUM", "order_date", date > as_of, _says("Order date ", date.cast("string"), " is in the future")),
    ]


def timeliness(p: Record, as_of: Column) -> list[Rule]:
    date = iso_date(_first(p, ["order_date", "Order Date", "transaction_date"]))
    return [
        Rule("TIMELINESS_FUTURE_DATE", "TIMELINESS", "MEDIUM", "order_date", date > as_of, _says("Date ", date.cast("string"), " is in the future")),
        Rule("TIMELINESS_STALE_DATE", "TIMELINESS", "MEDIUM", "order_date", date < F.add_months(as_of, -24), _says("Date ", date.cast("string"), " is more than two years old")),
    ]


def accuracy(p: Record) -> list[Rule]:
    """One rule for each field name as it may be spelt; other spellings go through ``Record.spelt``."""
    rules = []
    for code, names, allowed in (("ACCURACY_INVALID_CURRENCY", ("currency", "currency_code", "curr"), CURRENCIES), ("ACCURACY_INVALID_COUNTRY", ("country", "country_code", "nation"), COUNTRIES)):
        for f in names:
            value = p.spelt(f)
            rules.append(Rule(code, "ACCURACY", "LOW", f, value.isNotNull() & ~F.upper(trim(value)).isin(*allowed), _says(f"{f}: '", value, "' is not among the known ones")))
    return rules


def rules_for(p: Record, copies: Column, as_of: Column) -> list[Rule]:
    return [*completeness(p), *validity(p), *uniqueness(copies), *consistency(p, as_of), *timeliness(p, as_of), *accuracy(p)]


def user_rule(code: str, dimension: str, severity: str, field: str, expression: str) -> Rule:
    """A rule of the user's: a SQL condition on the staged row that a good record meets."""
    return Rule(code, dimension, severity, field, ~F.coalesce(F.expr(expression), F.lit(False)), F.lit(f"Rule not met: {expression}"))


def judge(staged: DataFrame, as_of: str, extra: list[Rule] | None = None, dimensions: set[str] | None = None, payloads: bool = False) -> DataFrame:
    """keys, record_hash, fired: each record with the rules that it breaks, from one reading of the staged rows. This slim table is
    written, and issues, counts and totals come from it; payloads are neither read nor hashed again. With ``payloads`` it has them as well, for
    steps that need them next: a source is then read once."""
    record = Record()
    rules = [*rules_for(record, F.lit(None), F.lit(as_of).cast("date")), *(extra or [])]
    wanted = [(i, r) for i, r in enumerate(rules) if (dimensions is None or r.dimension in dimensions) and r.code != DUPLICATE]
    none = F.array().cast("array<struct<rule_ord:int,rule:string,dimension:string,severity:string,field:string,message:string>>")
    # no higher-order function around the rules: what such a function takes is evaluated without generated code
    fired = F.flatten(F.array(*[F.when(r.condition, F.array(_issue(i, r))).otherwise(none) for i, r in wanted], none))
    return written(in_methods(record.laid_out(staged), "row_number", *KEYS, "record_hash", *["payload"] * payloads, fired.alias("fired")), "judged")


def _issue(i: int, r: Rule) -> Column:
    return F.struct(F.lit(i).alias("rule_ord"), F.lit(r.code).alias("rule"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"), r.message.alias("message"))


def issues(judged: DataFrame, dimensions: set[str] | None = None) -> DataFrame:
    """Issues: keys, rule_ord, rule, dimension, severity, field, message, status. For uniqueness hashes are counted, and those with copies meet
    the keys again."""
    found = judged.select(*KEYS, F.explode("fired").alias("i")).select(*KEYS, "i.*", F.lit("OPEN").alias("status"))
    if dimensions is not None and "UNIQUENESS" not in dimensions:
        return found
    place, rule = next((i, r) for i, r in enumerate(rules_for(Record(), F.col("_copies"), F.current_date())) if r.code == DUPLICATE)
    copies = judged.groupBy("source_id", "record_hash").agg(F.count_if(~is_blank(F.col("record_hash"))).alias("_copies")).where("_copies > 1")
    again = judged.select(*KEYS, "record_hash").join(copies, ["source_id", "record_hash"]).where(rule.condition)
    return found.unionByName(again.select(*KEYS, _issue(place, rule).alias("i")).select(*KEYS, "i.*", F.lit("OPEN").alias("status")))


def check(staged: DataFrame, as_of: str, extra: list[Rule] | None = None, dimensions: set[str] | None = None) -> DataFrame:
    """The issues of staged rows, of some dimensions or all."""
    return issues(judge(staged, as_of, extra, dimensions), dimensions)


def rejected(issues: DataFrame) -> DataFrame:
    """Records with a critical issue and why, messages in rule order."""
    critical = issues.where("severity = 'CRITICAL'").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rule_ord", "message"))).alias("m"))
    return critical.select(*KEYS, F.array_join(F.transform("m", lambda x: x["message"]), "; ").alias("reason"))


def critical() -> Column:
    """Whether a judged record breaks a critical rule. Copies and drift, which are found later, are never critical."""
    return F.exists("fired", lambda i: i["severity"] == "CRITICAL")


def accepted(staged: DataFrame, issues: DataFrame) -> DataFrame:
    return staged.join(issues.where("severity = 'CRITICAL'").select(*KEYS).distinct(), KEYS, "left_anti")


def pass_fail(staged: DataFrame, issues: DataFrame) -> DataFrame:
    """For each source and job: records, those without a critical issue, and those with any."""
    marks = issues.groupBy(*KEYS).agg(F.max(F.col("severity") == "CRITICAL").alias("critical"))
    joined = staged.select(*KEYS).join(marks, KEYS, "left")
    return joined.groupBy("source_id", "job_id").agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(~F.coalesce("critical", F.lit(False))).alias("passed_records"), F.count_if(F.col("critical").isNotNull()).alias("failed_records")
    )


def issue_matrix(issues: DataFrame) -> DataFrame:
    return issues.groupBy("source_id", "job_id", "dimension", "severity").agg(F.count(F.lit(1)).alias("n"))


def scores(staged: DataFrame, issues: DataFrame) -> DataFrame:
    """Score of each dimension and overall, and a grade, for each source and job. A dimension loses
    1, 0.5, 0.2 or 0.05 for each issue over the number of records, and stays within 0 and 1."""
    four = "decimal(5,4)"
    penalty = F.coalesce(*[F.when(F.col("severity") == s, F.lit(w).cast("decimal(12,2)")) for s, w in PENALTIES.items()])
    lost = issues.groupBy("source_id", "job_id").agg(*[F.sum(F.when(F.col("dimension") == d, penalty)).alias(f"_{d}") for d in WEIGHTS])
    totals = staged.groupBy("source_id", "job_id").agg(F.count(F.lit(1)).alias("total_records"))
    both = totals.join(lost, ["source_id", "job_id"], "left")
    zero, one = F.lit("0").cast("decimal(38,10)"), F.lit("1").cast("decimal(38,10)")

    def score(d: str) -> Column:
        share = F.coalesce(F.col(f"_{d}"), F.lit(0)).cast("decimal(24,2)") / F.col("total_records").cast("decimal(12,0)")
        return F.round(F.greatest(zero, F.least(one, one - share.cast("decimal(38,10)"))), 4).cast(four)

    each = both.select("source_id", "job_id", "total_records", *[score(d).alias(d.lower()) for d in WEIGHTS])
    overall = sum((F.col(d.lower()) * F.lit(w).cast("decimal(3,2)") for d, w in WEIGHTS.items()), F.lit("0").cast("decimal(3,2)"))
    graded = each.withColumn("overall", F.round(overall, 4).cast(four))
    letter = F.lit("F")
    for least, g in reversed(GRADES):
        letter = F.when(F.col("overall") >= F.lit(least).cast(four), g).otherwise(letter)
    return graded.withColumn("grade", letter)
