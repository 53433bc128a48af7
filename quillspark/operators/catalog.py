"""Document catalogue: admission, state, reuse and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

READY = ["ready", "partially_ready"]
# Accepted file types and size, processing stages and their progress.
ALLOWED_EXTENSIONS = [".pdf", ".xlsx"]
MAX_BYTES = 20 * 1024 * 1024
STAGES = ["uploaded", "parsed", "structured", "embedded", "indexed"]
STAGE_PROGRESS = {"uploaded": 20, "parsed": 20, "structured": 40, "embedded": 70, "indexed": 100}


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^/.](\.[^./]*)$", 1))


def upload_reason(filename: Column, size: Column) -> Column:
    """Why an upload is refused, null when it is accepted."""
    return (
        F.when(~extension(filename).isin(ALLOWED_EXTENSIONS), F.concat(F.lit("Invalid type: "), extension(filename)))
        .when(size > MAX_BYTES, "File too large (> 20MB)"))


def visible_documents(documents: DataFrame, user: Column | None = None) -> DataFrame:
    """Ready or partly ready documents, of one user if given."""
    found = documents.where(F.col("status").isin(READY))
    return found.where(F.col("user_id") == user) if user is not None else found


def readiness(status: Column) -> Column:
    """Reason a document cannot be used yet, null when it can."""
    return (F.when(status.isNull(), "not_found").when(status == "failed", "failed").when(status == "processing", "processing"))


def progress(status: Column, stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv])
    return (
        F.when(status == "failed", 0).when(status == "ready", 100).when(status == "partially_ready", 70)
        .when(stage == "embedded", 40).when(stage == "indexed", 70)
        .otherwise(F.coalesce(F.element_at(table, F.coalesce(stage, F.lit("uploaded"))), F.lit(0))))


def must_run(stage: Column, target: Column) -> Column:
    """Whether a document still has to pass ``target``; an unknown stage runs."""
    order = F.array(*[F.lit(s) for s in STAGES])
    at, goal = F.array_position(order, stage), F.array_position(order, target)
    return F.coalesce((at == 0) | (goal == 0) | (at < goal), F.lit(True))


def status_counts(documents: DataFrame) -> DataFrame:
    waiting = (F.col("status") == "processing") & (F.coalesce("processing_stage", F.lit("uploaded")) == "uploaded")
    return documents.groupBy("user_id").agg(
        F.count_if(F.col("status") == "processing").alias("processing"), F.count_if(waiting).alias("queued"),
        F.count_if(F.col("status") == "ready").alias("completed"),
        F.count_if(F.col("status") == "partially_ready").alias("partially_ready"),
        F.count_if(F.col("status") == "failed").alias("failed"))


def upload_decisions(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Duplicate of the user's own document, clone of another's, or new work.

    ``uploads(upload_id, user_id, file_hash)``. The existing documents are
    reduced to one donor per hash and one per (user, hash) before the joins, so
    a hash with many copies joins as one row.
    """
    ready = documents.where("status = 'ready'")
    donor = F.min_by("doc_id", F.struct("created_at", "doc_id"))
    own = ready.groupBy("user_id", "file_hash").agg(donor.alias("own_doc"))
    other = ready.groupBy("file_hash").agg(donor.alias("other_doc"))
    rows = uploads.join(own, ["user_id", "file_hash"], "left").join(other, "file_hash", "left")
    return rows.withColumns({
        "decision": F.when(F.col("own_doc").isNotNull(), "duplicate").when(F.col("other_doc").isNotNull(), "clone").otherwise("process"),
        "source_doc": F.coalesce("own_doc", "other_doc")}).drop("own_doc", "other_doc")


def siblings(documents: DataFrame) -> DataFrame:
    """For every document the earliest other ready document of equal content.

    Two candidates per hash are enough: the first, and the second for the first.
    """
    from quillspark.operators.ordered import top_k

    first_two = top_k(documents.where("status = 'ready'"), ["file_hash"], [F.asc("created_at"), F.asc("doc_id")], 2, "_r")
    donors = first_two.groupBy("file_hash").agg(
        F.max(F.when(F.col("_r") == 1, F.col("doc_id"))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col("doc_id"))).alias("_b"))
    rows = documents.join(donors, "file_hash", "left")
    return rows.withColumn("sibling", F.when(F.col("_a") == F.col("doc_id"), F.col("_b")).otherwise(F.col("_a"))).drop("_a", "_b")


def clone_rows(table: DataFrame, clones: DataFrame) -> DataFrame:
    """Rows of the donors copied under the clones' ids. ``clones(doc_id, source_doc)``."""
    renamed = clones.select(F.col("doc_id").alias("_new"), F.col("source_doc").alias("doc_id"))
    copies = table.join(renamed, "doc_id").withColumn("doc_id", F.col("_new")).select(*table.columns)
    return table.unionByName(copies)


def purge(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``doomed(doc_id)``."""
    return {name: table.join(doomed.select("doc_id"), "doc_id", "left_anti") for name, table in tables.items()}
