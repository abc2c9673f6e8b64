"""Greedy burst windows: at least N items from at least M accounts within W seconds.

The input is a projection that holds no text, so detection cannot depend on content.
Output rows describe clusters; no column judges a single account.

Plan (per tenant, project and rule; see README for the reasoning on skew):

* equal (account, moment) rows are merged first, with map-side combining;
* an item at ``t`` counts for every window start in [t-W, t]; as an account it counts only
  for starts after that account's previous item. Both are +1/-1 marks on the time line, so
  item and distinct-account counts of all windows are two running sums. No window is ever
  held as a set;
* the running sums are per time slot, with the parts of an interval that cross a slot border
  booked in both slots, so a project is never one task;
* which of the qualifying starts fire is :func:`murmur.operators.spacing.choose_spaced`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import ids
from murmur.functions.moments import MICROS, from_micros, micros, precision_floor
from murmur.operators.spacing import choose_spaced

#: Columns detection may read. Nothing derived from what was said.
OBSERVATION_COLUMNS = [
    "tenant_id",
    "project_id",
    "source_id",
    "content_id",
    "account_id",
    "capture_id",
    "last_capture_id",
    "posted_at",
    "timestamp_precision",
]
SCOPE = ["tenant_id", "project_id"]
KEYS = [*SCOPE, "rule_id"]

#: A slot of the time line spans about this long, and two rule windows at least: a wide rule
#: does not make few and huge slots, nor a narrow one very many.
SLOT_SECONDS = 3600


@dataclass(frozen=True)
class BurstRule:
    """Parameters as data. A new rule is a shadow rule and disabled until measured."""

    rule_id: str = "burst"
    name: str = "burst windows"
    window_seconds: int = 120
    minimum_items: int = 4
    minimum_accounts: int = 3
    shadow: bool = True
    enabled: bool = False

    @property
    def slot_seconds(self) -> int:
        """Length of a slot: a whole number of windows."""
        return self.window_seconds * max(2, SLOT_SECONDS // self.window_seconds)


class RuleConfigurationError(ValueError):
    """The rule cannot measure anything on this input."""


def observations(content: DataFrame) -> DataFrame:
    """The detection view: live rows, whitelisted columns."""
    live = content
    if "deleted_at" in content.columns:
        live = content.where(F.col("deleted_at").isNull())
    return live.select(*[c for c in OBSERVATION_COLUMNS if c in content.columns])


def in_sources(frame: DataFrame, sources: DataFrame) -> DataFrame:
    """Keep rows of the given sources; an empty list keeps none."""
    return frame.join(sources.select("source_id").distinct(), "source_id", "left_semi")


def precision_guard(obs: DataFrame, rules: list[BurstRule]) -> DataFrame:
    """One row per scope and rule: coarsest timestamp step and whether the rule may run."""
    floors = obs.groupBy(*SCOPE).agg(
        F.max(precision_floor(F.col("timestamp_precision"))).cast("long").alias("floor_seconds")
    )
    return floors.select(
        "*", F.explode(_rule_structs(rules)).alias("rule")
    ).select(
        *SCOPE,
        F.col("rule.rule_id").alias("rule_id"),
        "floor_seconds",
        F.col("rule.window_seconds").alias("window_seconds"),
        (F.col("rule.window_seconds") >= 2 * F.col("floor_seconds")).alias("accepted"),
    )


def require_precision(obs: DataFrame, rules: list[BurstRule]) -> None:
    """Raise when any scope holds timestamps too coarse for a rule."""
    refused = precision_guard(obs, rules).where(~F.col("accepted")).limit(1).collect()
    if refused:
        row = refused[0]
        raise RuleConfigurationError(
            f"window of {row.window_seconds}s is too narrow for timestamps that step by "
            f"{row.floor_seconds}s (project {row.project_id})"
        )


def _rule_structs(rules: list[BurstRule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.window_seconds).cast("long").alias("window_seconds"),
            )
            for r in rules
        ]
    )


def _parameter(rules: list[BurstRule], name: str, scale: int = 1) -> Column:
    """A rule's parameter as a column, looked up by ``rule_no``."""
    values = [F.lit(getattr(r, name) * scale).cast("long") for r in rules]
    if len(values) == 1:
        return values[0]
    return F.get(F.array(*values), F.col("rule_no"))


def cell_of(moment: Column, width: Column) -> Column:
    """Index of the interval of ``width`` that holds ``moment``; exact, never null here."""
    return F.coalesce(
        F.call_function("div", moment - F.pmod(moment, width), width), F.lit(0)
    ).cast("long")


def _with_rules(obs: DataFrame, rules: list[BurstRule], columns: list[str]) -> DataFrame:
    """Lean rows with ``t`` in microseconds, once per rule (a few literals, not a join)."""
    # A row without tenant, project or time belongs to nobody. Saying so here also keeps the
    # plans of all users of this frame alike, so that their shuffles are shared.
    owned = obs.where(
        F.col("tenant_id").isNotNull()
        & F.col("project_id").isNotNull()
        & F.col("posted_at").isNotNull()
    )
    number = F.lit(0)
    if len(rules) > 1:
        number = F.explode(F.array(*[F.lit(i) for i in range(len(rules))]))
    return owned.select(
        *SCOPE, *columns, micros(F.col("posted_at")).alias("t"), number.alias("rule_no")
    )


def _rule_id(rules: list[BurstRule]) -> Column:
    if len(rules) == 1:
        return F.lit(rules[0].rule_id)
    return F.get(F.array(*[F.lit(r.rule_id) for r in rules]), F.col("rule_no"))


def qualifying_starts(obs: DataFrame, rules: list[BurstRule]) -> DataFrame:
    """Every moment at which a window would fire: keys, slot, at, item_count, account_count.

    Rows of one (keys, slot) lie together and in order of ``at``.
    """
    gap = _parameter(rules, "window_seconds", MICROS)
    length = _parameter(rules, "slot_seconds", MICROS)
    scope = [*SCOPE, "rule_no"]
    points = (
        _with_rules(obs, rules, ["account_id"])
        .groupBy(*scope, "account_id", "t")
        .agg(F.count("*").alias("n"))
        .withColumn("own", cell_of(F.col("t"), length))
    )
    # The previous item of the account matters only within W, so the rows in the last W of a
    # slot are shown to the next slot as context and an account's history is cut per slot.
    own, t, n = F.col("own"), F.col("t"), F.col("n")
    near_end = t >= (own + 1) * length - gap
    shown = points.withColumn(
        "slot", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    before = F.lag("t").over(Window.partitionBy(*scope, "account_id", "slot").orderBy("t"))
    spans = (
        shown.withColumn("before", before)
        .where(F.col("slot") == own)
        .withColumn("opens", t - gap)
        .withColumn("account_opens", F.greatest("opens", F.col("before") + 1))
        .withColumn("border", F.col("slot") * length)
    )

    def mark(slot, at, items=0, accounts=0, items_end=0, accounts_end=0) -> Column:
        values = {"items": items, "accounts": accounts, "items_end": items_end,
                  "accounts_end": accounts_end}
        return F.struct(
            slot.alias("slot"),
            at.alias("at"),
            *[
                (v if isinstance(v, Column) else F.lit(v)).cast("long").alias(k)
                for k, v in values.items()
            ],
        )

    slot, border = F.col("slot"), F.col("border")
    opens, account_opens = F.col("opens"), F.col("account_opens")
    together = account_opens == opens
    first, account_first = F.greatest(opens, border), F.greatest(account_opens, border)
    same_first = account_first == first
    one = F.when(together, 1).otherwise(0)
    marks = F.array_compact(
        F.array(
            mark(slot, t, items_end=n, accounts_end=1),
            mark(slot, first, n, F.when(same_first, 1).otherwise(0)),
            F.when(~same_first, mark(slot, account_first, 0, 1)),
            F.when(opens < border, mark(slot - 1, opens, n, one)),
            F.when(~together & (account_opens < border), mark(slot - 1, account_opens, 0, 1)),
        )
    )
    sums = ["items", "accounts", "items_end", "accounts_end"]
    line = (
        spans.select(*scope, F.inline(marks))
        .groupBy(*scope, "slot", "at")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    upto = (
        Window.partitionBy(*scope, "slot")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # What ends at a moment still counts there: opened so far, less what ended before.
    return (
        line.withColumn(
            "item_count", F.sum(F.col("items") - F.col("items_end")).over(upto)
            + F.col("items_end"),
        )
        .withColumn(
            "account_count", F.sum(F.col("accounts") - F.col("accounts_end")).over(upto)
            + F.col("accounts_end"),
        )
        .where(
            (F.col("items_end") > 0)
            & (F.col("item_count") >= _parameter(rules, "minimum_items"))
            & (F.col("account_count") >= _parameter(rules, "minimum_accounts"))
        )
        .select(
            *SCOPE,
            _rule_id(rules).alias("rule_id"),
            "slot",
            "at",
            "item_count",
            "account_count",
            gap.alias("gap"),
            length.alias("slot_length"),
        )
    )


def burst_starts(
    obs: DataFrame, rules: list[BurstRule] | None = None, covered: DataFrame | None = None
) -> DataFrame:
    """The windows that fire, by start: keys, at (microseconds), counts, gap."""
    starts = qualifying_starts(obs, rules or [BurstRule()])
    return choose_spaced(starts, KEYS, keep=["item_count", "account_count"], covered=covered)


def members(
    obs: DataFrame, starts: DataFrame, rules: list[BurstRule] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Observations inside the windows, one row per item and window, with columns ``keep`` of the window.

    Joined on a cell of one window length. Windows of a key do not overlap, so a cell meets
    at most two of them and the range test never multiplies rows; a heavy cell is split by
    the adaptive skew join because each row stands for itself.
    """
    chosen = rules or [BurstRule()]
    columns = [
        c for c in ("source_id", "content_id", "account_id", "capture_id", "last_capture_id")
        if c in obs.columns
    ]
    width = _parameter(chosen, "window_seconds", MICROS)
    items = _with_rules(obs, chosen, columns).select(
        *SCOPE, _rule_id(chosen).alias("rule_id"), *columns, "t",
        cell_of(F.col("t"), width).alias("cell"),
    )
    cell = cell_of(F.col("at"), F.col("gap"))
    windows = starts.select(
        *KEYS, "at", "gap", *(keep or []), F.explode(F.array(cell, cell + 1)).alias("cell")
    )
    return (
        items.join(windows, [*KEYS, "cell"])
        .where((F.col("t") >= F.col("at")) & (F.col("t") <= F.col("at") + F.col("gap")))
        .select(*KEYS, "at", *(keep or []), *columns, "t")
    )


def finding_id(at: Column = None) -> Column:
    """Derived from scope, rule and start, so that a retried job writes the same id."""
    moment = F.col("at") if at is None else at
    return ids.uuid5(
        ids.CONTENT_NAMESPACE,
        F.concat_ws(
            "|", F.lit("finding"), "tenant_id", "project_id", "rule_id", moment.cast("string")
        ),
    )


def findings(inside: DataFrame, rules: list[BurstRule] | None = None) -> DataFrame:
    """One row per cluster, from :func:`members`. All aggregates combine map-side.

    Items, accounts and captures stay in their own tables (:func:`members`,
    :func:`finding_accounts`, :func:`finding_captures`), as they may be many.
    """
    chosen = rules or [BurstRule()]
    per_account = inside.groupBy(*KEYS, "at", "account_id").agg(
        F.count("*").alias("n"), F.max("t").alias("last_t"), F.min("source_id").alias("source_id")
    )
    grouped = per_account.groupBy(*KEYS, "at").agg(
        F.sum("n").alias("item_count"),
        F.count("*").alias("account_count"),
        F.max("last_t").alias("last_t"),
        F.min("source_id").alias("source_id"),
    )
    return _finding_rows(grouped, chosen)


def findings_of_starts(
    obs: DataFrame, starts: DataFrame, rules: list[BurstRule] | None = None
) -> DataFrame:
    """The rows of :func:`findings`, with the counts that ``starts`` holds already.

    Only the last moment and the source are read from the items, by an aggregate that combines
    map-side to one row per window; no item is shuffled for its account.
    """
    chosen = rules or [BurstRule()]
    counts = ["item_count", "account_count"]
    grouped = (
        members(obs, starts, chosen, keep=counts)
        .groupBy(*KEYS, "at", *counts)
        .agg(F.max("t").alias("last_t"), F.min("source_id").alias("source_id"))
    )
    return _finding_rows(grouped, chosen)


def _finding_rows(grouped: DataFrame, chosen: list[BurstRule]) -> DataFrame:
    """Clusters with keys, at, counts, last_t and source_id as records of findings."""

    def of_rule(value) -> Column:
        out = F.lit(value(chosen[0]))
        for rule in chosen[1:]:
            out = F.when(F.col("rule_id") == rule.rule_id, F.lit(value(rule))).otherwise(out)
        return out

    grouped = grouped.select(
        "*",
        of_rule(lambda r: r.window_seconds).alias("window_seconds"),
        of_rule(lambda r: r.minimum_items).alias("minimum_items"),
        of_rule(lambda r: r.minimum_accounts).alias("minimum_accounts"),
        of_rule(lambda r: r.name).alias("rule_name"),
    )
    return grouped.select(
        finding_id().alias("finding_id"),
        *KEYS,
        "rule_name",
        "source_id",
        from_micros(F.col("at")).alias("window_start"),
        from_micros(F.col("last_t")).alias("window_end"),
        "item_count",
        "account_count",
        signals().alias("signals"),
        F.lit(True).alias("shadow"),
    )


def signals() -> Column:
    """Exactly three measurements, each with its threshold and whether it was met."""

    def signal(name: str, observed: Column, threshold: Column, passed: Column, text: str):
        return F.struct(
            F.lit(name).alias("name"),
            observed.cast("double").alias("observed"),
            threshold.cast("double").alias("threshold"),
            passed.alias("passed"),
            F.lit(text).alias("description"),
        )

    span = (F.col("last_t") - F.col("at")) / F.lit(MICROS)
    width = F.col("window_seconds")
    # Names and descriptions that appear in stored findings.
    return F.array(
        signal(
            "item_count",
            F.col("item_count"),
            F.col("minimum_items"),
            F.col("item_count") >= F.col("minimum_items"),
            "items published inside the window",
        ),
        signal(
            "distinct_accounts",
            F.col("account_count"),
            F.col("minimum_accounts"),
            F.col("account_count") >= F.col("minimum_accounts"),
            "distinct accounts contributing to the window",
        ),
        signal(
            "window_span_seconds",
            span,
            width,
            span <= width,
            "elapsed time between the first and last item",
        ),
    )


def finding_accounts(inside: DataFrame) -> DataFrame:
    """Membership: one row per finding and account, with the items it contributed."""
    return (
        inside.groupBy(*KEYS, "at", "account_id")
        .agg(F.count("*").alias("item_count"))
        .select(finding_id().alias("finding_id"), "tenant_id", "account_id", "item_count")
    )


def finding_captures(inside: DataFrame) -> DataFrame:
    """Distinct captures per finding."""
    return (
        inside.groupBy(*KEYS, "at", "capture_id")
        .agg(F.count("*").alias("item_count"))
        .select(finding_id().alias("finding_id"), "tenant_id", "capture_id", "item_count")
    )


def detect(obs: DataFrame, rules: list[BurstRule] | None = None) -> DataFrame:
    """Observations to findings in one call.

    The job fails if a scope's timestamps are too coarse for a rule; the check is part of the
    plan and costs one small aggregate.
    """
    chosen = rules or [BurstRule()]
    found = findings(members(obs, burst_starts(obs, chosen), chosen), chosen)
    if "timestamp_precision" not in obs.columns:
        return found
    return found.unionByName(_refusal(obs, chosen, found))


def _refusal(obs: DataFrame, rules: list[BurstRule], like: DataFrame) -> DataFrame:
    """No rows, or an error for the first refused scope. A filter, so that nothing prunes it."""
    message = F.concat(
        F.lit("window of "), F.col("window_seconds").cast("string"),
        F.lit("s is too narrow for timestamps that step by "),
        F.col("floor_seconds").cast("string"), F.lit("s (project "),
        F.coalesce("project_id", F.lit("none")), F.lit(")"),
    )
    refused = precision_guard(obs, rules).where(
        F.when(~F.col("accepted"), F.raise_error(message).cast("boolean")).otherwise(F.lit(False))
    )
    return refused.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def diagnostics(obs: DataFrame) -> DataFrame:
    """How wide the search was: observations and distinct accounts per scope."""
    per_account = obs.groupBy(*SCOPE, "account_id").agg(F.count("*").alias("n"))
    return per_account.groupBy(*SCOPE).agg(
        F.sum("n").alias("observations"), F.count("*").alias("accounts")
    )
