"""Structural check of submitted snapshot texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill import constants as K


def _kind(doc: Column, path: str) -> Column:
    """'OBJECT<...', 'ARRAY<...', 'VOID' or a scalar type name; NULL if the path is missing."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def validate_snapshots(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``ok``, ``reason`` and the normalised ``status``; order of the tests as listed here."""
    df = payloads.withColumn("_doc", F.try_parse_json(body))
    df = df.withColumn("_root", _kind(F.col("_doc"), "$"))
    df = df.withColumns({f"_k_{c}": _kind(F.col("_doc"), f"$.{c}") for c in K.CATEGORIES})
    reason = F.when(F.col("_doc").isNull(), "not json").when(
        ~F.col("_root").startswith("OBJECT"), "not an object")
    for category in K.CATEGORIES:
        kind = F.col(f"_k_{category}")
        wrong = kind.isNotNull() & (kind != "VOID") & ~kind.startswith("ARRAY")
        reason = reason.when(wrong, f"invalid {category}")
    missing = F.lit(True)
    for category in K.CATEGORIES:
        missing = missing & F.col(f"_k_{category}").isNull()
    reason = reason.when(missing, "no category").otherwise("")
    status = F.coalesce(F.try_variant_get("_doc", "$.status", "string"), F.lit("success"))
    df = df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "")
    df = df.withColumn("status", F.when(F.col("ok"), status))
    return df.drop("_doc", "_root", *[f"_k_{c}" for c in K.CATEGORIES])


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to publish, rows to quarantine)."""
    return checked.where("ok"), checked.where("not ok")
