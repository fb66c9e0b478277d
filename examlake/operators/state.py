"""State that depends on earlier decisions, folded over a key's ordered events; and what jobs and files are now.

A denied event is not recorded, so it does not count against later ones: this is no window aggregate. The fold keeps
as many times as the quota allows, not all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import streamed


def quota(events: DataFrame, key: str, seconds: Column, order: str, window: int, most: int) -> DataFrame:
    """ST1: allow an event if fewer than ``most`` were allowed in the ``window`` seconds before it: (key, id, allowed)."""

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        recent: list[int] = []
        for t, i in own:
            recent = [x for x in recent if t is not None and x > t - window]
            ok = len(recent) < most
            if ok and t is not None:
                recent.append(t)
            yield i, ok

    some = events.select(key, seconds.cast("long").alias("_t"), F.col(order).cast("long").alias(order))
    return streamed(some, key, ["_t", order], ["_t", order], each, f"`{order}` long, allowed boolean")


def throttle(events: DataFrame, key: str, seconds: Column, order: str, wait: int) -> DataFrame:
    """ST2: allow an event if the last allowed one is ``wait`` seconds ago."""
    return quota(events, key, seconds, order, wait, 1)


def last_job(jobs: DataFrame, key: str, order: str, state: str, live: list[str], failed: list[str]) -> DataFrame:
    """ST8 and ST9: each key's latest live job, and whether its very last job failed."""
    return jobs.groupBy(key).agg(
        F.max(F.when(F.col(state).isin(live), F.col(order))).alias("live_job"),
        F.max(F.struct(order, state))[state].isin(failed).alias("failed"),
    )


def manifest_changes(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """ST14: files of a manifest that are gone or differ."""
    now = after.select(path, F.col(digest).alias("_now"))
    both = before.join(now, path, "left")
    return both.where(~F.col(digest).eqNullSafe(F.col("_now"))).select(path, F.when(F.col("_now").isNull(), "deleted").otherwise("modified").alias("change"))


def mask(value: Column) -> Column:
    """A secret with its first and last four characters, if it is long enough to hide something."""
    return F.when(F.char_length(value) >= 10, F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4)))).otherwise("...")


def drift(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """ST13: keys on both sides whose values differ, masked."""
    other = right.select(key, F.col(value).alias("_other"))
    return left.join(other, key).where(F.col(value) != F.col("_other")).select(key, mask(F.col(value)).alias("left"), mask(F.col("_other")).alias("right"))


def sessions(rows: DataFrame, as_of: Column, expires: str, owner: str) -> DataFrame:
    """ST4: sessions that hold at a time, by owner."""
    return rows.where(F.col(expires) > as_of).groupBy(owner).agg(F.count("*").alias("n_live"), F.max(expires).alias("until"))


def session_users(asked: DataFrame, sessions: DataFrame, users: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """ST4: whose sessions some tokens are: (token, outcome, user_id) and the sessions after that.

    ``live`` sessions are touched, ``expired`` ones that were asked for go; tokens that are null or empty, or have no session of a user that there is, are ``unknown``.
    ``sessions`` has (token, user_id, expires_at, last_seen_at), one row for each token.
    """
    some = asked.select("token").distinct()
    found = some.join(sessions.join(users.select("user_id"), "user_id", "left_semi").where("token <> ''"), "token", "left")
    outcome = F.when(F.col("user_id").isNull(), "unknown").when(F.col("expires_at") < as_of, "expired").otherwise("live")
    told = found.select("token", outcome.alias("outcome"), F.when(outcome == "live", F.col("user_id")).alias("user_id"))
    after = sessions.join(told.select("token", F.col("outcome").alias("_outcome")), "token", "left").where(~F.col("_outcome").eqNullSafe(F.lit("expired")))
    seen = F.when(F.col("_outcome") == "live", as_of).otherwise(F.col("last_seen_at"))
    return told, after.withColumn("last_seen_at", seen).select(*sessions.columns)


def read_progress(lines: DataFrame, key: str, order: str, read: Column) -> DataFrame:
    """(key, done, total) after all of a log's lines: the furthest page and the last total; ``read`` is struct<done, total> of a line."""
    some = lines.withColumn("_p", read)
    return some.groupBy(key).agg(F.max("_p.done").alias("done"), F.max_by("_p.total", F.when(F.col("_p.total").isNotNull(), F.col(order))).alias("total"))


def sweep(status: Column, started: Column, as_of: Column, seconds: int) -> Column:
    """ST6: what still runs after so long has been orphaned and counts as an error."""
    late = F.unix_timestamp(as_of) - F.unix_timestamp(started) >= seconds
    return F.when((status == "running") & late, "error").otherwise(status)


def timing(changed: Column, started: Column, assembled: Column, as_of: Column, busy: int = 180) -> Column:
    """ST5: struct<idle, busy, elapsed> in seconds: since the last change, whether that is short, and from the start to the
    assembly, or to ``as_of`` before there is one; elapsed is null without a start."""
    idle = F.unix_timestamp(as_of) - F.unix_timestamp(changed)
    elapsed = F.unix_timestamp(F.coalesce(assembled, as_of)) - F.unix_timestamp(started)
    return F.struct(idle.alias("idle"), (idle < busy).alias("busy"), elapsed.alias("elapsed"))


def log_line(text: Column, most: int = 400) -> Column:
    """ST7: a log line without control characters, cut to a length."""
    return F.left(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""), F.lit(most))
