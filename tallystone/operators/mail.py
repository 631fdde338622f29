"""Mail headers and written dates: events with confidence, hops of a message, addresses, dates in prose.

All of it are column expressions over the header text; a message's hops are few, so they stay in its row until they are
rows of their own. Header lines that begin with a blank go on the line before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.temporal import parse_mail_date

# The months that written dates may have.
MONTHS = [
    "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
_NUMERIC_DATE = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"
WRITTEN_DATE = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{_NUMERIC_DATE}|[0-9]{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+[0-9]{{4}})(?![\p{{L}}\p{{N}}_])"


def unfolded(headers: Column) -> Column:
    return F.regexp_replace(headers, r"\r?\n[ \t]+", " ")


def header(headers: Column, name: str) -> Column:
    """The value of the first header of that name, in any case; null if there is none."""
    return F.get(header_values(headers, name), F.lit(0))


def header_values(headers: Column, name: str) -> Column:
    """The values of all headers of that name in the order in which they stand."""
    return F.transform(F.regexp_extract_all(unfolded(headers), F.lit(rf"(?im)^{name}:[ \t]*([^\r\n]*)"), F.lit(1)), lambda x: F.btrim(x))


def address(raw: Column) -> Column:
    """``user@example.com`` from ``Name <user@example.com>`` or ``user@example.com (Name)``; else the text without blanks around it."""
    bracketed = F.regexp_extract(raw, r"<\s*([^<>\s]+)\s*>", 1)
    bare = F.btrim(F.regexp_replace(raw, r"\s*\([^)]*\)\s*", " "))
    return F.when(bracketed != "", bracketed).otherwise(F.when(bare == "", F.btrim(raw)).otherwise(bare))


def hops(mails: DataFrame, key: str, headers: str) -> DataFrame:
    """key, hop (0 for the newest), from_host, by_host, protocol, id and at (null if unreadable) of every Received header.

    A token in brackets is a comment and counts as none; the date is what stands behind the last semicolon.
    """
    rows = mails.select(key, F.posexplode(header_values(F.col(headers), "Received")).alias("hop", "_line"))

    def token(word: str) -> Column:
        found = F.regexp_extract("_line", rf"(?i){word}\s+([^\s;]+)", 1)
        return F.when((found != "") & ~found.startswith("("), found)

    date = F.when(F.contains("_line", F.lit(";")), F.btrim(F.substring_index("_line", ";", -1)))
    return rows.select(key, "hop", token("from").alias("from_host"), token("by").alias("by_host"), token("with").alias("protocol"), token("id").alias("id"), parse_mail_date(date).alias("at"))


def header_events(mails: DataFrame, key: str, headers: str, now: Column) -> DataFrame:
    """key, event, at, confidence and artifact of the dates in mail headers.

    The first Date header is when a message was sent: HIGH if it can be read, else LOW at ``now``. Each Received header
    with a readable date is a receipt, MEDIUM; others give no row.
    """
    sent_text = header(F.col(headers), "Date")
    sent = mails.select(key, sent_text.alias("_text")).where("_text <> ''").withColumn("_at", parse_mail_date(F.col("_text")))
    read = F.col("_at").isNotNull()
    sent = sent.select(
        key, F.lit("email_sent").alias("event"), F.coalesce("_at", now).alias("at"), F.when(read, "HIGH").otherwise("LOW").alias("confidence"), F.concat(F.when(read, "Date:").otherwise("unparseable_date:"), "_text").alias("artifact")
    )
    lines = mails.select(key, F.explode(header_values(F.col(headers), "Received")).alias("_line"))
    # What stands behind the first semicolon, as this source reads it.
    texts = lines.select(key, F.btrim(F.regexp_extract("_line", r"^[^;]*;\s*(.+)$", 1)).alias("_text")).withColumn("_at", parse_mail_date(F.col("_text")))
    received = texts.where("_at IS NOT NULL").select(key, F.lit("email_received").alias("event"), F.col("_at").alias("at"), F.lit("MEDIUM").alias("confidence"), F.concat(F.lit("Received:"), "_text").alias("artifact"))
    return sent.unionByName(received)


def written_dates(text: Column) -> Column:
    """The dates in a text as they stand: 3/4/2024, 2024-04-03, 3 avril 2024 or 3 April 2024, in any case."""
    return F.regexp_extract_all(text, F.lit(WRITTEN_DATE), F.lit(0))


def with_dates(text: Column) -> Column:
    """A claim's text with the dates it mentions behind it, if any."""
    found = written_dates(text)
    return F.when(F.size(found) > 0, F.concat(text, F.lit(" [dates: "), F.array_join(found, ", "), F.lit("]"))).otherwise(text)
