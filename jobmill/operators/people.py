"""Exam eligibility by age, and the document locker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.dates import age_ymd
from jobmill.functions.numbers import file_category, file_extension
from jobmill.functions.text import first_present
from jobmill.operators.dedupe import first_n
from jobmill.session import broadcast_if_small


def decimal_age(age: Column) -> Column:
    return age.years + age.months / F.lit(12.0) + age.days / F.lit(365.0)


def exam_eligibility(persons: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """Persons with every exam they may sit.

    The range condition has no equality, so each person meets the fixed table of 13 rules, which
    is broadcast; rows are emitted only where the age fits.
    """
    day = F.lit(as_of).cast("date")
    aged = persons.where(F.col("dob") < day).withColumn("age", age_ymd("dob", day))
    aged = aged.withColumn("age_decimal", decimal_age(F.col("age")))
    limit = (
        F.when(F.col("category") == "obc", F.col("max_obc"))
        .when(F.col("category").isin("sc", "scst"), F.col("max_scst"))
        .when(F.col("category") == "pwd", F.col("max_pwd"))
        .otherwise(F.col("max_gen"))
    )
    fits = F.col("age_decimal").between(F.col("min_age"), limit)
    return aged.join(broadcast_if_small(rules), fits).select(
        "person_id", "category", "exam", F.col("age.years").alias("years"), F.col("age.months").alias("months"),
        "min_age", limit.alias("max_age"))


# ------------------------------------------------------------------ document locker


def accept_uploads(uploads: DataFrame, max_docs: int = K.LOCKER_MAX_DOCS,
                   max_bytes: int = K.LOCKER_MAX_BYTES) -> DataFrame:
    """Per user the first uploads of an accepted size, with extension and default category."""
    sized = uploads.where(F.col("size") <= max_bytes)
    kept = first_n(sized, ["owner"], ["uploaded_at", "id"], max_docs)
    return kept.withColumns({"ext": file_extension("name"), "category": file_category("name")})


def of_category(docs: DataFrame, category: str = "all") -> DataFrame:
    return docs if category == "all" else docs.where(F.col("category") == category)


def with_category_label(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_small(labels), "category", "left").withColumn(
        "category_label", first_present("category_label", F.lit(K.LOCKER_LABELS["other"])))


def checklist(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Every user with every required item, and whether a document name mentions its first word.

    Each document is turned into the array of items it mentions, and the distinct ones are
    exploded; the eleven items per user come from an explode as well.  So there is one equi-join on
    (user, item) and no document-by-item product.
    """
    name = F.lower(F.col("name"))
    mentions = F.array_compact(F.array(*[
        F.when(name.contains(item.lower().split(" ")[0]), F.lit(item)) for item in K.LOCKER_CHECKLIST]))
    found = docs.select("owner", F.explode(mentions).alias("item")).distinct().withColumn("_found", F.lit(True))
    wanted = F.array(*[F.struct(F.lit(i).cast("bigint").alias("item_pos"), F.lit(item).alias("item"))
                       for i, item in enumerate(K.LOCKER_CHECKLIST)])
    required = users.select("owner").distinct().select("owner", F.explode(wanted).alias("_w")).select("owner", "_w.*")
    return required.join(found, ["owner", "item"], "left").select(
        "owner", "item", "item_pos", F.coalesce("_found", F.lit(False)).alias("done"))


def locker_summary(docs: DataFrame) -> DataFrame:
    return docs.groupBy("owner", "category").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("size").cast("bigint").alias("bytes"))
