"""Windowed conversation memory over a table of messages(session_id, turn, role, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings


def _newest_first() -> Window:
    return Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("role"))


def recent_history(messages: DataFrame, n: int | None = None) -> DataFrame:
    """The last n messages of each session (by default 2 per round of the window)."""
    n = n or 2 * DEFAULTS.window_rounds
    return messages.withColumn("age", F.row_number().over(_newest_first())).where(F.col("age") <= n)


def session_list(messages: DataFrame, limit: int = 50, title: int = 30) -> DataFrame:
    """session_id, title (the beginning of its first user message), last_turn: the latest sessions first."""
    own = messages.groupBy("session_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.col("turn"))).alias("t"), F.max("turn").alias("last_turn"))
    short = F.concat(F.left("t", F.lit(title)), F.when(F.length("t") > title, "...").otherwise(""))
    return own.select("session_id", F.coalesce(short, F.lit("")).alias("title"), "last_turn").orderBy(F.desc("last_turn"), F.desc("session_id")).limit(limit)


def message_count(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))


def overflow_summary(messages: DataFrame, settings: Settings = DEFAULTS, window: int | None = None) -> DataFrame:
    """session_id, summary: messages older than the window, as 'role: text' lines, their last characters.

    Only as many of the newest overflowing messages are gathered as can fill the summary:
    each line adds at least one character and a line end.
    """
    keep = window or 2 * settings.window_rounds
    aged = messages.withColumn("age", F.row_number().over(_newest_first())).where((F.col("age") > keep) & (F.col("age") <= keep + settings.summary_chars))
    line = F.concat("role", F.lit(": "), F.right(F.coalesce("text", F.lit("")), F.lit(settings.summary_chars)))
    lines = aged.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("o"), line.alias("line")))).alias("rows"))
    return lines.select("session_id", F.right(F.trim(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")), F.lit(settings.summary_chars)).alias("summary"))


def compact(existing: str, overflow: list[tuple[str, str]], summarizer: Callable[[str], str] | None = None, chars: int = DEFAULTS.summary_chars) -> str:
    """One session's new summary. The summarizer gets old summary and new lines; its answer is cut at
    the end. Without one, or if it fails or answers nothing, the tail of both is kept."""
    if not overflow:
        return existing
    lines = "\n".join(f"{role}: {text}" for role, text in overflow)
    if summarizer is not None:
        try:
            if answer := (summarizer(f"{existing}\n\n{lines}") or "").strip():
                return answer[:chars]
        except Exception:  # the summarizer is foreign code: any failure means the fallback
            pass
    return f"{existing}\n{lines}".strip()[-chars:]


def clear(messages: DataFrame, session_id) -> DataFrame:
    return messages.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))
