"""Time-dependent scores as Columns; ``as_of`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.config import ATOM_CONFIDENCE, ATOM_PATTERNS, DAY, TTL_BASE


def decay_score(kind: Column, days: Column, ttl: Column) -> Column:
    """Linear, step or exponential decay; unknown kinds are exponential, ttl is at least 1."""
    t, d = F.greatest(ttl, F.lit(1.0)), F.greatest(days, F.lit(0.0))
    return (
        F.when(kind == "linear", F.greatest(F.lit(0.0), 1 - d / t))
        .when(kind == "step", F.when(d <= t, 1.0).otherwise(0.05))
        .otherwise(F.pow(F.lit(2.0), -d / F.greatest(F.lit(0.5), t / 2)))
    )


def atom_ttl(kind: Column, importance: Column, reinforced: Column, event_days: Column) -> Column:
    """Days to live; ``event_days`` counts for plans only and may be null."""
    base = F.lit(TTL_BASE["unknown"][0])
    for k, (days, _) in TTL_BASE.items():
        base = F.when(kind == k, F.lit(days)).otherwise(base)
    base = F.when((kind == "planned") & event_days.isNotNull(), base + F.greatest(event_days, F.lit(0.0))).otherwise(base)
    return F.greatest(F.lit(1.0), base * (0.5 + importance) * (1 + F.least(F.lit(0.5), 0.1 * reinforced)))


def decay_kind(kind: Column) -> Column:
    out = F.lit("exponential")
    for k, (_, d) in TTL_BASE.items():
        out = F.when(kind == k, F.lit(d)).otherwise(out)
    return out


def classify(c: Column) -> Column:
    """A time with an action is planned; else preference, relation, state, action; unknown if none occurs."""
    has = {k: c.rlike(p) for k, p in ATOM_PATTERNS.items()}
    return (
        F.when(has["time"] & has["action"], "planned").when(has["preference"], "preference").when(has["relation"], "relational")
        .when(has["stative"], "factual").when(has["action"], "episodic").otherwise("unknown")
    )


def class_confidence(kind: Column) -> Column:
    out = F.lit(ATOM_CONFIDENCE["unknown"])
    for k, v in ATOM_CONFIDENCE.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def recency(as_of: float, created: Column, accessed: Column, rate: float = 0.01) -> Column:
    days = F.greatest(F.lit(0.0), (F.lit(as_of) - F.greatest(created, accessed)) / DAY)
    return F.exp(-F.lit(rate) * days)


def epoch_seconds(c: Column) -> Column:
    """Seconds from a number that may be in milliseconds (above 1e11); null and NaN give null."""
    v = c.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.when(v > 1e11, v / 1000).otherwise(v))


def relative_date(c: Column, as_of: float) -> Column:
    """The date a text speaks of, as seconds from midnight of ``as_of``; null if it names none.

    Day words (longest first), weekdays with week words, week words, then month and day, which roll
    into the next year when past.
    """
    today = F.to_date(F.timestamp_seconds(F.lit(as_of)))
    out = None
    for w, n in (("大后天", 3), ("后天", 2), ("明天", 1), ("今天", 0), ("昨天", -1), ("前天", -2), ("tomorrow", 1), ("yesterday", -1)):
        cond = c.contains(w)
        out = F.when(cond, F.date_add(today, n)) if out is None else out.when(cond, F.date_add(today, n))
    day = F.regexp_extract(c, "周([一二三四五六日天])", 1)
    at = F.when(day == "天", 6).otherwise(F.instr(F.lit("一二三四五六日"), day) - 1) - F.weekday(today)
    week = F.regexp_extract(c, "(上周|本周|下下周|下周)?周[一二三四五六日天]", 1)
    shift = F.when(week == "上周", at - 7).when(week == "本周", at).when(week == "下周", at + 7).when(week == "下下周", at + 14).otherwise(F.pmod(at, F.lit(7)))
    out = out.when(day != "", F.date_add(today, shift.cast("int")))
    for w, n in (("上周", -7), ("本周", 0), ("下下周", 14), ("下周", 7)):
        out = out.when(c.contains(w), F.date_add(today, n))
    m, d = F.regexp_extract(c, "([0-9]{1,2})月([0-9]{1,2})[日号]", 1), F.regexp_extract(c, "([0-9]{1,2})月([0-9]{1,2})[日号]", 2)
    this = F.try_to_date(F.concat_ws("-", F.year(today).cast("string"), m, d), "yyyy-M-d")
    return out.when(m != "", F.when(this < today, F.add_months(this, 12)).otherwise(this))
