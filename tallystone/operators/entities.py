"""Entity extraction, normal forms and resolution.

Normal forms are built-in string functions. Unicode compatibility forms (NFKC) have no built-in: texts that are ASCII
already skip the Arrow function that others pass through. Word lists and patterns are this library's own.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

TITLES = ["mr", "mrs", "ms", "dr", "prof", "sir", "herr", "frau", "mme"]
SUFFIXES = ["inc", "ltd", "llc", "gmbh", "ag", "sa", "sarl", "corp", "co", "plc", "bv"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[A-Za-z0-9./?=&_#%:-]+",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "mac": r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b",
    "phone": r"\+[0-9][0-9 ().-]{7,}[0-9]",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}


@pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def clean_text(text: Column) -> Column:
    """NFKC, control characters as spaces, white space runs as one space, ends trimmed."""
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(_nfkc(text))
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, r"[\x00-\x1F\x7F]", " "), r"\s+", " "))


def person_form(name: Column) -> Column:
    """Lower-cased words without punctuation and titles (unless all are titles), sorted."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9\s#]", "")), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(TITLES))
    return F.array_join(F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(words)), " ")


def organisation_form(name: Column) -> Column:
    """Lower-cased, trailing legal suffixes removed however many follow one another."""
    base = F.btrim(F.regexp_replace(F.lower(name), r"[.,]", " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(base, r"\s+", " "), rf"(?: (?:{'|'.join(SUFFIXES)}))+$", ""))


def email_form(address: Column) -> Column:
    return F.regexp_replace(F.lower(address), r"\+[^@]*@", "@")


def software_form(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), r"\s+v?[0-9]+(?:\.[0-9]+)*\s*$", ""))


def device_form(name: Column) -> Column:
    mac = F.regexp_replace(F.upper(name), "-", ":")
    return F.when(name.rlike(r"^[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}$"), mac).otherwise(F.lower(name))


def entity_id(kind: Column, form: Column) -> Column:
    return F.sha2(F.concat_ws(":", kind, form), 256)


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """One row an entity from its mentions (entity_id, kind, display, artifact, confidence, ts, pos).

    Aliases and artifacts are made distinct before they are listed, so an entity with very many mentions lists only
    its different names.
    """
    facts = mentions.groupBy("entity_id", "kind").agg(
        F.min_by("display", "pos").alias("display"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("mentions"), F.count_distinct("artifact").alias("artifacts")
    )
    names = mentions.select("entity_id", "display").distinct().groupBy("entity_id").agg(F.array_sort(F.collect_list("display")).alias("aliases"))
    return facts.join(names, "entity_id")


def extract_patterns(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, kind and value of every pattern found in a text, distinct within it; values are whole matches."""
    found = [F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias("values")) for k, p in PATTERNS.items()]
    one = docs.select(id_column, F.explode(F.array(*found)).alias("f"))
    return one.select(id_column, "f.kind", F.explode("f.values").alias("value"))


def redacted(text: Column) -> Column:
    """E-mail addresses, then social security numbers, then phone numbers replaced by placeholders."""
    out = text
    for kind in ("email", "ssn", "phone"):
        out = F.regexp_replace(out, PATTERNS[kind], f"[{kind}]")
    return out


def without_instructions(text: Column) -> Column:
    """Lines that read like orders to a model are dropped."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"(?i)^\s*(?:ignore|disregard|forget)\b.*\b(?:above|previous|instructions)\b"))
    return F.array_join(lines, "\n")


def text_stats(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.filter(F.split(t, r"[ \t\n\r]+"), lambda w: w != ""))
    return docs.select(id_column, F.length(t).alias("chars"), words.alias("words"), (F.regexp_count(t, F.lit("\n")) + 1).alias("lines"))


def classify_actor(rows: DataFrame, known: DataFrame, domains: DataFrame, personal: list[str], names: list[tuple[str, list[str]]], claimant: str = "claimant") -> DataFrame:
    """The actor of each row (address, filename, path, modality) by the first rule that knows.

    A row with an address goes by it alone: a known address, a personal domain (the claimant), an institution's domain,
    else an actor of its own. The others go by parts of the file name (``names``: actor and parts, in order), by the
    claimant's parts in the path, by being an image or a recording (the claimant), else they are unknown. ``known``
    (address, actor) and ``domains`` (domain, actor) are joined by key; Spark broadcasts them while small.
    """
    address = F.lower(F.btrim("address"))
    out = rows.withColumn("_address", address).withColumn("_domain", F.when(address.contains("@"), F.element_at(F.split(address, "@"), -1)).otherwise(""))
    out = out.join(known.select(F.col("address").alias("_a"), F.col("actor").alias("_known")), F.col("_address") == F.col("_a"), "left")
    out = out.join(domains.select(F.col("domain").alias("_d"), F.col("actor").alias("_by_domain")), F.col("_domain") == F.col("_d"), "left")
    own = F.concat(F.lit("email:"), F.regexp_replace(F.substring_index("_address", "@", 1), r"[^\p{L}\p{N}]", "_"), F.lit("_"), F.replace(F.col("_domain"), F.lit("."), F.lit("_")))
    by_address = F.coalesce("_known", F.when(F.col("_domain").isin(personal), claimant), "_by_domain", own)
    has = lambda column, parts: reduce(or_, (F.lower(column).contains(p) for p in parts), F.lit(False))
    by_name = F.coalesce(*(F.when(has("filename", parts), actor) for actor, parts in names), F.lit(None).cast("string"))
    by_path = F.when(has("path", next((parts for actor, parts in names if actor == claimant), [])), claimant)
    rest = F.coalesce(by_name, by_path, F.when(F.col("modality").isin("image", "recording"), claimant), F.lit("unknown"))
    return out.withColumn("actor", F.when(F.coalesce("_address", F.lit("")) != "", by_address).otherwise(rest)).drop("_address", "_domain", "_a", "_known", "_d", "_by_domain")


def duplicates_of_first(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Rows whose content an earlier row has, with the first such row: an aggregate and a join by hash, no sorting of groups."""
    hashed = rows.where(F.col(content).isNotNull()).select(order, F.sha2(content, 256).alias("sha"))
    first = hashed.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashed.join(first, "sha").where(F.col(order) > F.col("first")).select(order, "first", "sha")


def patched(rows: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with ``column`` replaced where the patch (key, column) has it."""
    return rows.join(patch.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def received_hops(header: Column) -> Column:
    """The hosts of Received lines, in order."""
    return F.regexp_extract_all(header, F.lit(r"(?im)^Received:\s*from\s+([A-Za-z0-9.-]+)"), F.lit(1))


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(order)))
