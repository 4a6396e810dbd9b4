"""Structural breaks in a stream of edges: spikes, decays, regime changes; what is said of them."""

from __future__ import annotations

import json
import logging
import smtplib
import urllib.request
from email.message import EmailMessage

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.prefix import previous

log = logging.getLogger(__name__)
EVENT = "bar long, event_type string, leader string, follower string, old_value double, new_value double, description string"


def described(kind: Column, leader: Column, follower: Column, old: Column, new: Column, text: Column) -> Column:
    """The description, or a default one where it's empty."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, text).otherwise(F.format_string("%s: %s > %s from %.4f to %.4f", kind, leader, follower, old, new))


def breaks(updates: DataFrame, window: int = 60, z: float = 2.0, decay: float = 0.5, least: int = 5) -> DataFrame:
    """Events (EVENT) of updates (source, target, bar, te): a pair's value against its window - 1 values before.

    A spike is more than z standard deviations above the mean, a decay below `decay` times it; at
    least `least` values must be held, the new one included.
    """
    w = Window.partitionBy("source", "target").orderBy("bar").rowsBetween(1 - window, -1)
    rows = updates.withColumns({"n": F.count("te").over(w), "m": F.avg("te").over(w), "s": F.stddev_pop("te").over(w)}).where(F.col("n") + 1 >= least)
    score = F.when(F.col("s") > 1e-10, (F.col("te") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)))
    spike = rows.where(score > z).withColumns({"event_type": F.lit("te_spike"), "text": F.format_string("%s > %s: transfer entropy %.4f is above its mean %.4f", "source", "target", "te", "m")})
    fall = rows.where((F.col("m") > 1e-10) & (F.col("te") < decay * F.col("m"))).withColumns({"event_type": F.lit("te_decay"), "text": F.format_string("%s > %s: transfer entropy %.4f is below its mean %.4f", "source", "target", "te", "m")})
    return spike.union(fall).select("bar", "event_type", F.col("source").alias("leader"), F.col("target").alias("follower"), F.col("m").alias("old_value"), F.col("te").alias("new_value"), F.col("text").alias("description"))


def regime_changes(regimes: DataFrame) -> DataFrame:
    """Events (EVENT) of regimes (bar, regime): bars whose regime isn't the one before."""
    rows = previous(regimes.select("bar", "regime"), "bar", {"last": "regime"}).where("last <> regime")
    return rows.select("bar", F.lit("regime_change").alias("event_type"), F.lit("").alias("leader"), F.lit("").alias("follower"), F.col("last").cast("double").alias("old_value"), F.col("regime").cast("double").alias("new_value"), F.format_string("regime %d became %d", "last", "regime").alias("description"))


def most_likely(probabilities: DataFrame) -> DataFrame:
    """(bar, regime): the position of the largest of the probabilities (array `prob`), the first of equals."""
    return probabilities.select("bar", (F.array_position("prob", F.array_max("prob")) - 1).cast("int").alias("regime"))


# How the kinds are marked.
MARKS = {"te_spike": "[SPIKE]", "te_decay": "[DECAY]", "regime_change": "[REGIME]"}


def alert_text(events: DataFrame) -> DataFrame:
    """(text): one message of all events; events worth telling are few."""
    mark = F.lit("[EVENT]")
    for kind, m in MARKS.items():
        mark = F.when(F.col("event_type") == kind, m).otherwise(mark)
    lines = events.select(F.struct("bar", "event_type", "leader", "follower", F.concat_ws(" ", mark, "description").alias("line")).alias("e"))
    every = lines.agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]).alias("ls"))
    return every.select(F.when(F.col("n") == 0, "No structural breaks.").otherwise(F.concat_ws("\n", F.concat(F.col("n").cast("string"), F.lit(" structural breaks")), "ls")).alias("text"))


def daily_report(events: DataFrame, title: str = "Daily report") -> DataFrame:
    """(text): a section for each kind of event, in markdown."""
    sections = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("bar", "leader", "follower", F.concat(F.lit("- "), "description").alias("line")))), lambda e: e["line"]).alias("ls"))
    parts = sections.select("event_type", F.concat_ws("\n", F.concat(F.lit("## "), "event_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), "ls").alias("part"))
    every = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "part"))), lambda p: p["part"]).alias("ps"))
    return every.select(F.concat_ws("\n\n", F.lit(f"# {title}"), F.when(F.size("ps") == 0, F.array(F.lit("Nothing happened."))).otherwise(F.col("ps"))).alias("text"))


def narrative_prompt(events: DataFrame, context: str = "") -> DataFrame:
    """(text): what a language model would be asked about the events."""
    lines = events.agg(F.transform(F.array_sort(F.collect_list(F.struct("bar", "event_type", "leader", "follower", "description"))), lambda e: F.concat(F.upper(e["event_type"]), F.lit(": "), e["description"])).alias("ls"))
    return lines.select(F.concat_ws("\n", F.lit("These breaks in lead-lag relations were found:"), "ls", F.lit(f"Context: {context or 'none given'}"), F.lit("Explain in three sentences what may link them, and what to watch next.")).alias("text"))


def narrate(prompt: str, key: str = "", call=None) -> str:
    """call(prompt, key) if there is a key; placeholder and error texts otherwise, never an exception."""
    if not key or call is None:
        return "No narrative: no key is set."
    try:
        return call(prompt, key)
    except Exception as error:  # a narrative is never worth a failed job
        return f"No narrative: {error}"


def post_webhook(text: str, url: str, timeout: float = 10.0) -> bool:
    """Posts {"text": …}; False without a url or if it fails."""
    if not url:
        return False
    try:
        request = urllib.request.Request(url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except Exception as error:
        log.warning("webhook: %s", error)
        return False


def send_mail(text: str, host: str, port: int, sender: str, to: str = "", password: str = "", subject: str = "Structural breaks") -> bool:
    """Sends the text, to the sender if nobody else is named; False without a host or if it fails."""
    if not host:
        return False
    try:
        message = EmailMessage()
        message["Subject"], message["From"], message["To"] = subject, sender, to or sender
        message.set_content(text)
        with smtplib.SMTP(host, port, timeout=10) as server:
            server.starttls()
            if password:
                server.login(sender, password)
            server.send_message(message)
        return True
    except Exception as error:
        log.warning("mail: %s", error)
        return False
