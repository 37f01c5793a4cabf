"""Corpus queries: ownership, joins, counts, rankings and the correction queue.

All are DataFrame -> DataFrame and leave the physical plan to Catalyst: counts
are aggregated before they are joined, exclusions are anti joins, and limited
orderings become a top-k without a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def owned(results: DataFrame, pages: DataFrame, documents: DataFrame, user_id: int) -> DataFrame:
    """Results of one user's documents, through pages and documents, with the document's name."""
    own = documents.where(F.col("user_id") == user_id).select(F.col("id").alias("document_id"), "name", "user_id")
    on_page = pages.select(F.col("id").alias("page_id"), "page_number", "document_id")
    return results.drop("document_id").join(on_page, "page_id").join(own, "document_id")


def document_counts(documents: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """Each document with its number of pages and of results, counted apart and so without fan-out."""
    n_pages = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    n_results = results.groupBy("document_id").agg(F.count("*").alias("result_count"))
    keyed = documents.withColumnRenamed("id", "document_id")
    joined = keyed.join(n_pages, "document_id", "left").join(n_results, "document_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("page_count", "result_count")})


def uncorrected(results: DataFrame, corrections: DataFrame) -> DataFrame:
    return results.join(corrections.select(F.col("result_id").alias("id")), "id", "left_anti")


def correction_queue(documents: DataFrame, results: DataFrame, corrections: DataFrame, user_id: int, n: int = 10) -> DataFrame:
    """The user's next ``n`` results to correct: least confident first, then from the documents corrected most."""
    own = documents.where(F.col("user_id") == user_id).select(F.col("id").alias("document_id"), "name")
    done = corrections.groupBy("document_id").agg(F.count("*").alias("done"))
    rows = uncorrected(results, corrections).join(own, "document_id").join(done, "document_id", "left")
    rows = rows.withColumn("document_corrections", F.coalesce("done", F.lit(0)).cast("long"))
    return rows.orderBy("confidence", F.col("document_corrections").desc(), "id").limit(n).select("id", "document_id", "name", "text", "confidence", "document_corrections")


def remaining(documents: DataFrame, results: DataFrame, corrections: DataFrame, batch: int = 10) -> DataFrame:
    """Per user, how many results stay uncorrected after one more batch."""
    rows = uncorrected(results, corrections).join(documents.select(F.col("id").alias("document_id"), "user_id"), "document_id")
    return rows.groupBy("user_id").agg(F.greatest(F.lit(0), F.count("*") - batch).cast("long").alias("remaining"))


def latest_models(models: DataFrame) -> DataFrame:
    """Each user's newest version."""
    newest = Window.partitionBy("user_id").orderBy(F.col("version").desc(), F.col("trained").desc())
    return models.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def model_status(documents: DataFrame, corrections: DataFrame, models: DataFrame) -> DataFrame:
    """Per user: the model's version, corrections in all, and those that came after its training."""
    totals = corrections.join(documents.select(F.col("id").alias("document_id"), "user_id"), "document_id").groupBy("user_id").agg(F.count("*").alias("total"))
    users = documents.select("user_id").distinct()
    rows = users.join(totals, "user_id", "left").join(latest_models(models), "user_id", "left")
    total = F.coalesce("total", F.lit(0)).cast("long")
    return rows.select("user_id", F.col("version").isNotNull().alias("has_model"), "version", total.alias("total"), (total - F.coalesce("trained", F.lit(0))).alias("since"))


def training_gate(status: DataFrame) -> DataFrame:
    """Whether a training may start, and the version that it would make."""
    decided = F.when(F.col("total") == 0, "no corrections").when(F.col("since") <= 0, "nothing new").otherwise("start")
    return status.select("user_id", decided.alias("decision"), (F.coalesce("version", F.lit(0)) + 1).alias("next_version"))


def uncertainty(confidence: Column, corrected: Column | None = None) -> Column:
    """Half the missing confidence and half its binary entropy, 0.3 less if corrected; unknown confidence is 0.5."""
    c = F.least(F.greatest(F.coalesce(confidence, F.lit(0.5)), F.lit(1e-9)), F.lit(1 - 1e-9))
    entropy = -(c * F.log2(c) + (1 - c) * F.log2(1 - c))
    score = 0.5 * (1 - c) + 0.5 * entropy
    return score if corrected is None else score - F.when(corrected, 0.3).otherwise(0.0)


def page_text(results: DataFrame) -> DataFrame:
    """A page's trimmed texts, by y, x and id, joined by line ends."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "id", F.trim("text").alias("t"))))
    return results.where(F.trim("text") != "").groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda r: r["t"]), "\n").alias("page_text"))


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of a grouped column, no interpolation."""
    own = F.array_sort(F.collect_list(values))
    return F.element_at(own, (F.floor(F.size(own) / 2) + 1).cast("int"))


def best_rotation(trials: DataFrame) -> DataFrame:
    """(page_id, rotation, confidence) -> the rotation with the highest mean confidence, the smaller one among equals."""
    means = trials.groupBy("page_id", "rotation").agg(F.avg("confidence").alias("mean"))
    best = F.max(F.struct("mean", (-F.col("rotation")).alias("back")))
    return means.groupBy("page_id").agg(best.alias("b")).select("page_id", (-F.col("b.back")).alias("rotation"), F.col("b.mean").alias("mean_confidence"))


def region_of(boxes: DataFrame, regions: DataFrame, fallback: str = "MAIN_INK") -> DataFrame:
    """The first region of a box's page, in list order, with which the box shares area; the full page is no region.

    Equality on the page comes first, so the overlap test runs page by page.
    """
    cross_w = F.least(F.col("x") + F.col("w"), F.col("rx") + F.col("rw")) - F.greatest("x", "rx")
    cross_h = F.least(F.col("y") + F.col("h"), F.col("ry") + F.col("rh")) - F.greatest("y", "ry")
    hits = boxes.join(regions.where(~F.col("full_page")), "page_id").where((cross_w > 0) & (cross_h > 0))
    first = hits.groupBy("id").agg(F.min(F.struct("region_index", "label")).alias("r")).select("id", F.col("r.label").alias("label"))
    return boxes.join(first, "id", "left").withColumn("label", F.coalesce("label", F.lit(fallback)))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes, 0 where they do not meet."""
    inter = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) * F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return F.coalesce(inter / F.nullif(aw * ah + bw * bh - inter, F.lit(0)), F.lit(0.0))


def region_by_iou(boxes: DataFrame, regions: DataFrame, at_least: float = 0.25) -> DataFrame:
    """The first region whose overlap ratio exceeds ``at_least``; else the main ink at 0.7."""
    c = F.col
    score = iou(c("x"), c("y"), c("w"), c("h"), c("rx"), c("ry"), c("rw"), c("rh"))
    hits = boxes.join(regions, "page_id").withColumn("score", score).where(F.col("score") > at_least)
    first = hits.groupBy("id").agg(F.min(F.struct("region_index", "label", "score")).alias("r"))
    return boxes.join(first, "id", "left").select("id", F.coalesce("r.label", F.lit("MAIN_INK")).alias("label"), F.coalesce("r.score", F.lit(0.7)).alias("score"))


def latest_text(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """Results with the text of their latest correction."""
    last = corrections.groupBy("result_id").agg(F.max_by("corrected_text", F.struct("minute", "id")).alias("newest")).withColumnRenamed("result_id", "id")
    return results.join(last, "id", "left").withColumn("text", F.coalesce("newest", "text")).drop("newest")


def drop_document(document_id: int, documents: DataFrame, pages: DataFrame, results: DataFrame, corrections: DataFrame) -> tuple[DataFrame, ...]:
    """The four tables without a document and all that hangs on it."""
    gone = documents.where(F.col("id") == document_id).select(F.col("id").alias("document_id"))
    gone_pages = pages.join(gone, "document_id", "left_semi").select(F.col("id").alias("page_id"))
    gone_results = results.join(gone_pages, "page_id", "left_semi").select(F.col("id").alias("result_id"))
    return (
        documents.join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti"), pages.join(gone, "document_id", "left_anti"),
        results.join(gone_pages, "page_id", "left_anti"), corrections.join(gone_results, "result_id", "left_anti"),
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of both by ``key``; where both have it, incoming values that are not null win."""
    joined = existing.alias("e").join(incoming.alias("i"), F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer")
    return joined.select(*[F.coalesce(f"i.{c}", f"e.{c}").alias(c) for c in existing.columns])


def replaced(existing: DataFrame, fresh: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``existing`` with all rows of ``keys`` replaced by ``fresh``; a key without fresh rows has none left."""
    return existing.join(keys.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(fresh)


def starts(log: DataFrame) -> DataFrame:
    """id, page_id, decision of each request to process a page: blocked while it is being processed, else started.

    ``log`` has id, page_id, ts and status; a request is a row with status
    processing. After a request the page is in processing either way, so the
    status before decides alone. :func:`streaming.status.decisions` is the same on a stream.
    """
    before = F.lag("status").over(Window.partitionBy("page_id").orderBy("ts", "id"))
    decision = F.when(before == "processing", "blocked").otherwise("started")
    return log.withColumn("decision", decision).where("status = 'processing'").select("id", "page_id", "decision")


def _latest_versions(models: DataFrame) -> DataFrame:
    return models.groupBy("user_id").agg(F.max("version").alias("resumed_from"))


def calibrated(asked: DataFrame, models: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows that a calibration appends, and the training that it starts.

    ``asked``: page_id, user_id, text, confidence (as recognised) and truth;
    ``models``: user_id, version; ``corrections``: user_id and their number so
    far. A row is both the result (text, confidence, model_version) and its
    correction, and names the version to be trained with 3 epochs at 1e-4.
    """
    rows = asked.join(_latest_versions(models), "user_id", "left").join(corrections, "user_id", "left")
    version = F.when(F.col("resumed_from").isNull(), "base").otherwise(F.concat(F.lit("user-v"), F.col("resumed_from").cast("string")))
    fresh = F.count("*").over(Window.partitionBy("user_id"))
    return rows.select(
        "page_id", "user_id", F.coalesce("text", F.lit("")).alias("original_text"), F.col("truth").alias("corrected_text"), "confidence", version.alias("model_version"),
        (F.coalesce("resumed_from", F.lit(0)) + 1).alias("new_version"), (F.coalesce("corrections", F.lit(0)) + fresh).alias("num_corrections"), F.lit(3).alias("epochs"), F.lit(1e-4).alias("learning_rate"),
    )


def training_settings(corrections: DataFrame, models: DataFrame) -> DataFrame:
    """A user's training, from the number of corrections: hyper-parameters, the version made and the one resumed from (null: none)."""
    rows = corrections.where("corrections > 0").join(_latest_versions(models), "user_id", "left")
    n = F.col("corrections")
    # Epochs, rates, decay and the adapter's rank and alpha.
    return rows.select(
        "user_id", "resumed_from", (F.coalesce("resumed_from", F.lit(0)) + 1).alias("version"), F.lit(3).alias("epochs"), F.least(F.lit(4), n).alias("batch_size"), F.greatest(F.lit(1), F.floor(n / 4)).alias("warmup_steps"),
        F.lit(5e-5).alias("learning_rate"), F.lit(0.01).alias("weight_decay"), F.lit(8).alias("rank"), F.lit(16).alias("alpha"),
    )


def model_choice(users: DataFrame, models: DataFrame, folder: str) -> DataFrame:
    """user_id, model, path: each user's latest adapter, to be loaded onto the base model, which is all that others have."""
    rows = users.select("user_id").distinct().join(_latest_versions(models), "user_id", "left")
    version = F.col("resumed_from").cast("string")
    path = F.concat(F.lit(f"{folder}/user_"), F.col("user_id").cast("string"), F.lit("/v"), version)
    return rows.select("user_id", F.coalesce(F.concat(F.lit("user-v"), version), F.lit("base")).alias("model"), path.alias("path"))
