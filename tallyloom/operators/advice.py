"""Advice on wasteful sessions: twelve rules, their ranking and summaries.

Every rule is one expression over a session row that is NULL when the rule does
not fire, so all rules run in one projection over the sessions.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.overlap import shared_length_udf
from ..functions.text import contains_any, half_up, strip
from ..rules import models as M
from .lookup import name_lookup

# Default thresholds, overridable per call.
THRESHOLDS: dict[str, Any] = {
    "waste_ratio": 3.0,
    "output_capped_ratio": 0.85,
    "small_task_max_tokens": 500,
    "avg_msg_token": 800,
    "first3_waste_ratio": 0.20,
    "first3_input_ratio": 0.60,
    "system_prompt_ratio": 0.25,
    "thinking_ratio": 2.0,
    "imbalance_turns": 20,
    "imbalance_ratio": 3.0,
    "zombie_days": 7,
    "idle_since": "time_start",  # or "time_end": the session's last message
    "zombie_token": 50_000,
    "fragmentation_threshold": 20,
    "fragmentation_avg_turns": 5,
    "fragment_min_tokens": 500,
    "max_per_session": 3,
}
INPUT, CONTEXT, PROVIDER, LIFECYCLE = "input_quality", "context_management", "provider_config", "session_lifecycle"
DIMENSIONS = {"A": INPUT, "B": CONTEXT, "C": PROVIDER, "D": LIFECYCLE}
# Name parts of costly models and of reasoning models.
COSTLY = ["flash", "pro", "gpt-4o", "claude-3.5", "claude-4"]
REASONING = ["reasoner", "r1", "thinking"]
CHEAPER = "deepseek-chat"

FIELDS = "severity string, dimension string, category string, value double, saved_tokens bigint, saved_usd double"
OUTPUT = ["session_id", "severity", "dimension", "category", "value", "saved_tokens", "saved_usd"]


def _severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "warning", 1).when(c == "info", 2).otherwise(99)


def _fire(category: str, condition: Column, severity: Column | str, value: Column, tokens=None, usd=None) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        condition,
        F.struct(
            severity.alias("severity"),
            F.lit(DIMENSIONS[category[0]]).alias("dimension"),
            F.lit(category).alias("category"),
            half_up(value.cast("double"), 4).alias("value"),
            (F.lit(0) if tokens is None else tokens).cast("long").alias("saved_tokens"),
            (F.lit(0.0) if usd is None else half_up(usd, 4)).alias("saved_usd"),
        ),
    )


def _ctx(field: str) -> Column:
    return F.col(f"context.{field}")


def _num(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _inputs() -> Column:
    return _num(F.col("total_input_tokens"))


def _outputs() -> Column:
    return _num(F.col("total_output_tokens"))


def _users() -> Column:
    return _num(_ctx("user_turns"))


def _replies() -> Column:
    return _num(_ctx("assistant_turns"))


def _model() -> Column:
    return F.lower(F.coalesce(F.col("model"), F.lit("")))


def message_overlap(sessions: DataFrame) -> DataFrame:
    """Add shared-substring lengths and ratios of first/second and first/last user messages.

    Pairs too short for any rule are passed as NULL, so they cost nothing.
    """
    df = sessions.withColumns({f"_{n}": strip(_ctx(f"{n}_msg")) for n in ("first", "second", "last")})
    n1, n2, n3 = F.length("_first"), F.length("_second"), F.length("_last")
    near = (n1 >= 25) & (n2 >= 25)
    far = (n1 >= 20) & (n3 >= 20)
    df = df.withColumns(
        {
            "near_length": F.when(near, F.least(n1, n2)),
            "far_length": F.when(far, F.least(n1, n3)),
            "near_shared": shared_length_udf(F.when(near, F.col("_first")), F.when(near, F.col("_second"))),
            "far_shared": shared_length_udf(F.when(far, F.col("_first")), F.when(far, F.col("_last"))),
            "far_longer": F.when(far, F.least(n1, n3) >= 50),
        }
    )
    return df.withColumns(
        {
            "near_ratio": F.col("near_shared") / F.col("near_length"),
            "far_ratio": F.col("far_shared") / F.col("far_length"),
        }
    ).drop("_first", "_second", "_last")


def rule_a1(t: Mapping) -> Column:
    """First and second message repeat each other."""
    r = F.col("near_ratio")
    fires = (F.col("near_shared") >= 5) & (r >= 0.25)
    return _fire("A1", fires, F.when(r < 0.65, "info").otherwise("warning"), r)


def rule_a2(t: Mapping) -> Column:
    """Messages are long on average, by characters or by tokens."""
    limit = t["avg_msg_token"]
    chars, tokens = _num(_ctx("total_chars")) / _users(), _inputs() / _users()
    fires = (_users() > 0) & ((chars > limit * 4) | (tokens > limit))
    mild = (chars <= limit * 4 * 1.5) & (tokens <= limit * 1.5)
    return _fire("A2", fires, F.when(mild, "info").otherwise("warning"), tokens)


def rule_a3(t: Mapping) -> Column:
    """The first six messages take most of the input and give little output."""
    sizes = _ctx("message_sizes")
    head = F.slice(sizes, 1, 6)

    def of(role: str) -> Column:
        mine = F.filter(head, lambda m: m["role"] == role)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda s, m: s + F.coalesce(m["estimated_tokens"], F.lit(0)))

    asked, answered = of("user") / _inputs(), of("assistant") / F.greatest(_outputs(), F.lit(1))
    fires = (
        (F.size(sizes) >= 3)
        & (_inputs() > 0)
        & (asked >= t["first3_input_ratio"])
        & (answered < t["first3_waste_ratio"])
    )
    return _fire("A3", fires, "warning", asked)


def rule_b1(t: Mapping) -> Column:
    """System prompts make up much of the input."""
    r = _num(_ctx("system_tokens")) / _inputs()
    level = F.when(r > 0.50, "critical").when(r > 0.35, "warning").otherwise("info")
    return _fire("B1", (_inputs() > 0) & (_num(_ctx("system_tokens")) > 0) & (r > t["system_prompt_ratio"]), level, r)


def rule_b2(t: Mapping, prices) -> Column:
    """Thinking is long next to the answer; saving per month of daily use."""
    thought, said = _num(_ctx("thinking_tokens")), _num(_ctx("thinking_output_tokens"))
    r = thought / F.greatest(said, F.lit(1))
    reasoning = contains_any(_model(), REASONING) | (thought > 0)
    price = F.coalesce(name_lookup(F.col("model"), prices, ["price_in", "price_out"])["price_out"], F.lit(0.0))
    fires = reasoning & (thought > 0) & (said > 0) & (r > t["thinking_ratio"])
    return _fire(
        "B2", fires, F.when(r > 4.0, "warning").otherwise("info"), r, usd=thought / F.lit(1e6) * price * F.lit(30)
    )


def rule_b3(t: Mapping) -> Column:
    """The user writes far more often than the assistant."""
    silent = (_users() > t["imbalance_turns"]) & (_replies() == 0)
    uneven = (_users() > 0) & (_replies() > 0) & (_users() / _replies() > t["imbalance_ratio"])
    value = _users() / F.greatest(_replies(), F.lit(1))
    return _fire("B3", silent | uneven, F.when(silent, "warning").otherwise("info"), value)


def rule_c1(t: Mapping, specs) -> Column:
    """Output comes close to the model's limit."""
    spec = name_lookup(F.col("model"), specs, ["context_window", "max_tokens"])
    window = F.coalesce(spec["context_window"], F.lit(M.DEFAULT_SPEC[0]))
    most = F.coalesce(spec["max_tokens"], F.lit(M.DEFAULT_SPEC[1]))
    r = _outputs() / most
    cut = _outputs() % most < most * F.lit(0.05)
    level = F.when(cut | (r > 0.95), "warning").otherwise("info")
    fires = (most > 0) & (_outputs() > 0) & (r >= t["output_capped_ratio"])
    return _fire("C1", fires, level, r, tokens=F.least(most * 2, window) - most)


def rule_c2(t: Mapping, prices) -> Column:
    """A costly model does a small task although a cheaper one is known."""
    fields = ["price_in", "price_out"]
    now = F.coalesce(name_lookup(F.col("model"), prices, fields)["price_in"], F.lit(0.0))
    then = F.coalesce(name_lookup(F.lit(CHEAPER), prices, fields)["price_in"], F.lit(0.0))
    known = _model().contains("flash") & _model().contains("deepseek")
    saved = (now - then) / F.lit(1e6) * _inputs()
    fires = contains_any(_model(), COSTLY) & (_inputs() <= t["small_task_max_tokens"]) & known
    return _fire("C2", fires, "info", saved * F.lit(1e6), usd=saved * F.lit(100))


def rule_c3(t: Mapping) -> Column:
    """First and last message share a long passage."""
    saved = F.floor(F.col("far_shared") / 4)
    fires = F.col("far_longer") & (F.col("far_shared") >= 30) & (saved >= 15)
    return _fire("C3", fires, "info", F.col("far_shared"), tokens=saved)


def rule_d1(t: Mapping, as_of) -> Column:
    """An old session still holds a large context; ``idle_since`` names the time of the context that counts."""
    start = F.unix_micros(_ctx(t["idle_since"]))
    idle = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - start) / 86_400_000_000)
    fires = (idle >= t["zombie_days"]) & (_inputs() >= t["zombie_token"])
    return _fire("D1", fires, F.when(_inputs() > 100_000, "warning").otherwise("info"), idle, tokens=_inputs())


def rule_d2(t: Mapping) -> Column:
    """First and last message have next to nothing in common."""
    same = (F.col("far_shared") >= 6) & (F.col("far_ratio") >= 0.25)
    return _fire("D2", F.col("far_shared").isNotNull() & ~same, "info", F.col("far_ratio"))


def rule_d3(t: Mapping) -> Column:
    """A short session with a normal ratio: possibly a fragment."""
    turns = _users() + _replies()
    fires = (
        (turns < t["fragmentation_avg_turns"])
        & (_num(F.col("input_output_ratio")) < t["waste_ratio"])
        & (_inputs() >= t["fragment_min_tokens"])
    )
    return _fire("D3", fires, "info", turns)


_NEEDS_OVERLAP = {"A1", "C3", "D2"}


def _rules(t: Mapping, prices, specs, as_of) -> dict[str, Column]:
    return {
        "A1": rule_a1(t),
        "A2": rule_a2(t),
        "A3": rule_a3(t),
        "B1": rule_b1(t),
        "B2": rule_b2(t, prices),
        "B3": rule_b3(t),
        "C1": rule_c1(t, specs),
        "C2": rule_c2(t, prices),
        "C3": rule_c3(t),
        "D1": rule_d1(t, as_of),
        "D2": rule_d2(t),
        "D3": rule_d3(t),
    }


def advise(
    sessions: DataFrame,
    as_of,
    *,
    thresholds: Mapping[str, Any] | None = None,
    rules: list[str] | None = None,
    prices=M.PRICES,
    specs=M.SPECS,
) -> DataFrame:
    """All advice of the chosen rules (default: all twelve), one row per session and rule."""
    t = {**THRESHOLDS, **(thresholds or {})}
    table = _rules(t, prices, specs, as_of)
    chosen = list(table) if rules is None else rules
    if _NEEDS_OVERLAP & set(chosen):
        sessions = message_overlap(sessions)
    found = F.filter(F.array(*[table[r] for r in chosen]), lambda a: a.isNotNull())
    df = sessions.select(F.col("id").alias("session_id"), F.explode_outer(found).alias("a"))
    return df.filter(F.col("a").isNotNull()).select("session_id", "a.*")


def fragmentation(sessions: DataFrame, as_of, *, days: int = 30, thresholds: Mapping[str, Any] | None = None) -> DataFrame:
    """Sources with many short sessions in the last ``days`` days."""
    t = {**THRESHOLDS, **(thresholds or {})}
    now = F.lit(as_of).cast("timestamp")
    recent = sessions.filter((F.col("start_time") > now - F.make_dt_interval(F.lit(days))) & (F.col("start_time") <= now))
    return (
        recent.groupBy("source")
        .agg(F.count(F.lit(1)).alias("sessions"), F.avg(_users() + _replies()).alias("_avg"))
        .filter((F.col("sessions") > t["fragmentation_threshold"]) & (F.col("_avg") < t["fragmentation_avg_turns"]))
        .select(
            "source",
            F.lit("info").alias("severity"),
            F.lit(LIFECYCLE).alias("dimension"),
            F.lit("D3").alias("category"),
            "sessions",
            half_up("_avg", 4).alias("avg_turns"),
        )
    )


def _gravest(advice: DataFrame) -> DataFrame:
    """One row per session and rule: the gravest, then the smallest by the other columns."""
    order = F.struct(_severity_rank(F.col("severity")).alias("rank"), "severity", "dimension", "value", "saved_tokens", "saved_usd")
    once = advice.groupBy("session_id", "category").agg(F.min(order).alias("a"))
    return once.select("session_id", "category", "a.*").drop("rank")


def top_advice(advice: DataFrame, most: int = THRESHOLDS["max_per_session"]) -> DataFrame:
    """At most ``most`` rows per session, one of each dimension before a second of any.

    A session holds at most one row per rule after the first step, so its window
    never exceeds the number of rules. Of several rows of a rule the gravest counts, then
    the smallest by dimension, value and savings.
    """
    rank = _severity_rank(F.col("severity"))
    kept = _gravest(advice)
    by_rank = [rank.asc(), F.col("category").asc()]
    session = W.partitionBy("session_id")
    df = kept.withColumn("_n", F.count(F.lit(1)).over(session)).withColumn(
        "_nth", F.row_number().over(W.partitionBy("session_id", "dimension").orderBy(*by_rank))
    )
    first = F.when((F.col("_n") > most) & (F.col("_nth") > 1), 1).otherwise(0)
    return (
        df.withColumn("position", F.row_number().over(session.orderBy(first, *by_rank)))
        .filter(F.col("position") <= most)
        .select(*OUTPUT, "position")
    )


def advice_by_dimension(advice: DataFrame) -> DataFrame:
    """Advice of a session as one list per dimension, in rank order (one entry per rule, as in ``top_advice``)."""
    item = F.struct(_severity_rank(F.col("severity")).alias("rank"), "category", "severity", "value")
    return _gravest(advice).groupBy("session_id", "dimension").agg(
        F.count(F.lit(1)).alias("advices"), F.sort_array(F.collect_list(item)).alias("items")
    )


def advice_summary(advice: DataFrame) -> DataFrame:
    """Counts per dimension and severity with sub-totals and the grand total (NULL stands for all)."""
    return advice.cube("dimension", "severity").agg(
        F.count(F.lit(1)).alias("advices"), half_up(F.sum("saved_usd"), 4).alias("saved_usd")
    )
