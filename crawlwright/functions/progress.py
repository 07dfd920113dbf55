"""Progress, speed, retry and condition expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

# States, error classes and their levels.
FINISHED_STATES = ["completed", "failed", "cancelled"]
ERROR_CLASSES = [
    (["SystemExit", "KeyboardInterrupt", "MemoryError"], "critical", "critical"),
    (["ConnectionError", "TimeoutError", "OSError"], "error", "high"),
    (["ValueError", "TypeError", "AttributeError"], "warning", "medium"),
]
SEVERITY_LEVELS = {"critical": "critical", "high": "error", "medium": "warning", "low": "info"}
EQUAL_TOLERANCE = 0.001


def percent(done, total, capped: bool = False) -> Column:
    """Share in percent; 0 when the total is unknown."""
    p = F.coalesce(F.try_divide(U._c(done) * 100.0, F.nullif(U._c(total), F.lit(0))), F.lit(0.0))
    return F.least(p, F.lit(100.0)) if capped else p


def speed(done, elapsed_seconds) -> Column:
    """Bytes per second; 0 without elapsed time."""
    return F.coalesce(F.try_divide(U._c(done).cast("double"), U._c(elapsed_seconds)), F.lit(0.0))


def eta(done, total, speed_col) -> Column:
    """Remaining seconds, or null when total or speed is unknown."""
    s = F.nullif(U._c(speed_col), F.lit(0.0))
    return F.try_divide((F.nullif(U._c(total), F.lit(0)) - U._c(done)).cast("double"), s)


def seconds_between(start, end) -> Column:
    return (F.unix_micros(U._c(end)) - F.unix_micros(U._c(start))) / 1e6


def duration(started, completed, now) -> Column:
    """Run time in seconds, null when not started."""
    return seconds_between(started, F.coalesce(U._c(completed), U._c(now)))


def is_finished(status) -> Column:
    """U41."""
    return U._c(status).isin(FINISHED_STATES)


def retry_delay(attempt, policy: str = "backoff", base: float = 1.0, cap: float = 60.0,
                retry_after=None, unhealthy=None, server_error=None, seed: int | None = None,
                jitter: bool = True) -> Column:
    """Planned delay of an attempt.

    ``backoff``: Retry-After wins, +-25 % before the cap.  ``policy``: attempts
    count from 1, factor 0.5 to 1 after the cap.  ``adaptive``: doubled while
    the host is unhealthy.  ``download``: delay and cap doubled on a 5xx.
    """
    n = U._c(attempt)
    rand = F.rand(seed) if jitter else F.lit(0.5)
    if policy == "backoff":
        wait = F.lit(base) * F.pow(F.lit(2.0), n)
        if retry_after is not None:
            wait = F.when(U._c(retry_after) > 0, U._c(retry_after).cast("double")).otherwise(wait)
        return F.least(wait * (rand * 0.5 + 0.75), F.lit(cap))
    if policy == "policy":
        delay = F.least(F.lit(base) * F.pow(F.lit(2.0), n - 1), F.lit(cap))
        return delay * (rand * 0.5 + 0.5) if jitter else delay
    if policy == "adaptive":
        delay = F.least(F.lit(base) * F.pow(F.lit(2.0), n), F.lit(cap))
        return F.when(U._c(unhealthy), delay * 2).otherwise(delay)
    if policy == "download":
        delay = F.lit(base) * F.pow(F.lit(2.0), n)
        return F.when(U._c(server_error), F.least(delay * 2, F.lit(cap * 2))).otherwise(F.least(delay, F.lit(cap)))
    raise ValueError(f"unknown policy: {policy}")


def error_level(class_names, severity=None) -> Column:
    """report level from an array of class names, own class first, then its ancestors."""
    names, out = U._c(class_names), F
    for classes, level, _ in ERROR_CLASSES:
        out = out.when(F.arrays_overlap(names, F.array(*map(F.lit, classes))), level)
    if severity is not None:
        s = U._c(severity)
        for name, level in SEVERITY_LEVELS.items():
            out = out.when(s == name, level)
        out = out.when(s.isNotNull(), "warning")
    return out.otherwise("info")


def error_severity(class_names) -> Column:
    """handler severity from the same ordered table."""
    names, out = U._c(class_names), F
    for classes, _, severity in ERROR_CLASSES:
        out = out.when(F.arrays_overlap(names, F.array(*map(F.lit, classes))), severity)
    return out.otherwise("low")


def should_retry(attempt, max_attempts, class_names=None, retry_classes=None) -> Column:
    """attempts left, and the class listed when there is a list."""
    left = U._c(attempt) < U._c(max_attempts)
    if retry_classes is None:
        return left
    listed = U._c(retry_classes)
    return left & (F.coalesce(F.size(listed) == 0, F.lit(True)) | F.arrays_overlap(U._c(class_names), listed))


def holds(value, condition, threshold) -> Column:
    """the condition is a column of the rule table."""
    v, c, t = U._c(value), U._c(condition), U._c(threshold)
    return (F.when(c == ">", v > t).when(c == "<", v < t)
            .when(c == "==", F.abs(v - t) < EQUAL_TOLERANCE)
            .when(c == "!=", F.abs(v - t) >= EQUAL_TOLERANCE).otherwise(False))


def threshold_status(value, warning, critical) -> Column:
    """critical, warning, healthy; unknown without thresholds."""
    v, w, c = U._c(value), U._c(warning), U._c(critical)
    return (F.when(c.isNull(), "unknown").when(v >= c, "critical").when(v >= w, "warning").otherwise("healthy"))


def load_status(cpu, memory) -> Column:
    """overall load word from processor and memory percent."""
    top = F.greatest(F.coalesce(U._c(cpu), F.lit(0.0)), F.coalesce(U._c(memory), F.lit(0.0)))
    return (F.when(top > 90, "CRITICAL").when(top > 70, "WARNING").when(top > 50, "MODERATE").otherwise("HEALTHY"))


def resource_status(cpu, memory, disk) -> Column:
    """strict limits 90/80 for the processor, 95/85 for memory and disk."""
    c, m, d = U._c(cpu), U._c(memory), U._c(disk)
    return (F.when((c > 90) | (m > 95) | (d > 95), "critical")
            .when((c > 80) | (m > 85) | (d > 85), "warning").otherwise("healthy"))
