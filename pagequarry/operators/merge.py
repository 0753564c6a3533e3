"""Upserts of pages, aliases, runs and overrides as set operations.

Events of one batch are folded onto the stored rows in the order of `seq`, as if applied one after the other.
A fold is one shuffle by the key: stored rows that have an event take part with seq -1, and the windows and ordered
aggregates that follow keep that partitioning and order. Stored rows without an event are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import falsy_null
from ..runtime import small_side

#: How each column of a page takes a later event (fixed values).
OVERWRITE = ("status_code", "crawl_status", "redirect_chain", "fetch_mode", "last_error", "run_id")
HASH_GATED = ("html_content", "clean_html")
KEEP_UNLESS_NEW = ("markdown", "markdown_enhanced", "structural_stats", "nav_structure", "title", "h1", "meta_description", "extraction_method", "junk_score", "content_hash", "sitemap_type_hint")
FALSY = ("status_code", "junk_score", "markdown", "markdown_enhanced", "title", "h1", "meta_description", "content_hash", "sitemap_type_hint", "html_content", "clean_html", "extraction_method", "last_error", "run_id")


def _as_written(events: DataFrame) -> DataFrame:
    """Empty values become null on the way in, a missing word count 0."""
    changed = {c: falsy_null(F.col(c)) for c in FALSY if c in events.columns}
    changed["word_count"] = F.coalesce("word_count", F.lit(0))
    return events.withColumns(changed)


def _last_known(column: str) -> Column:
    """Value of the latest event that has one."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("seq")))


def _last_even_null(column: str) -> Column:
    return F.max_by(F.struct(column), F.col("seq"))[column]


def merge_pages(stored: DataFrame, events: DataFrame, now: Column, markdown_policy: str = "keep", key: Column | None = None, top: int | None = None) -> DataFrame:
    """stored pages with events applied; events has the columns of a page but id and last_crawled_at, and seq.

    markdown_policy "hash_gated" lets Markdown change only together with the HTML. `key` may give another identity
    than final_url, e.g. a collated one. New pages get ids after the largest stored one (or after top, where stored
    is a part of the table), in the order of first seq.

    Stored rows without an event stay as they are, in place: only rows with one meet in the fold. Keys of stored rows
    are unique, as this function leaves them.
    """
    columns = stored.columns
    identity = key if key is not None else F.col("final_url")
    old = stored.withColumn("seq", F.lit(-1).cast("long")).withColumn("merge_key", identity)
    new = _as_written(events).withColumn("id", F.lit(None).cast("long")).withColumn("last_crawled_at", now).withColumn("merge_key", identity)
    # by hash: a stored row that only shares one takes part in the fold and comes out as it was
    hashes = small_side(new.select(F.xxhash64("merge_key").alias("key_hash")).distinct())
    old = old.withColumn("key_hash", F.xxhash64("merge_key"))
    untouched = old.join(hashes, "key_hash", "left_anti").select(*columns)
    both = old.join(hashes, "key_hash", "left_semi").drop("key_hash").unionByName(new.select(*columns, "seq", "merge_key"))
    w = Window.partitionBy("merge_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("hash_before", F.last("content_hash", ignorenulls=True).over(w)).withColumn("first_row", F.row_number().over(Window.partitionBy("merge_key").orderBy("seq")) == 1)
    both = both.withColumn("changes", F.col("first_row") | (F.col("content_hash").isNotNull() & (F.col("content_hash") != F.coalesce("hash_before", F.lit("")))))
    gated = (*HASH_GATED, "markdown", "markdown_enhanced", "structural_stats", "nav_structure") if markdown_policy == "hash_gated" else HASH_GATED
    kept = [c for c in KEEP_UNLESS_NEW if c not in gated]
    changed = F.when(F.col("changes"), F.col("seq"))
    aggregates = {
        "id": F.max("id"),
        "final_url": F.min_by("final_url", "seq"),
        "requested_url_original": F.min_by(F.struct("requested_url_original"), "seq")["requested_url_original"],
        "word_count": F.max_by("word_count", "seq"),
        "last_crawled_at": _last_even_null("last_crawled_at"),
        **{c: _last_even_null(c) for c in OVERWRITE},
        **{c: F.max_by(F.struct(c), changed)[c] for c in gated},
        **{c: _last_known(c) for c in kept},
    }
    merged = both.groupBy("merge_key").agg(*[v.alias(k) for k, v in aggregates.items()])
    ids = new_ids(stored.select(identity.alias("merge_key"), "id"), events.select(identity.alias("merge_key"), "seq"), top)
    merged = merged.join(ids, merged["merge_key"].eqNullSafe(ids["merge_key"]), "left").withColumn("id", F.coalesce("id", "new_id")).select(*columns)
    return untouched.unionByName(merged)


def new_ids(stored: DataFrame, events: DataFrame, top: int | None = None) -> DataFrame:
    """merge_key, new_id for keys of events that are not stored yet: numbers without gaps after top, the largest stored id.

    Only keys travel here. Within a hash bucket numbers follow first seq; buckets get their starts from counts, so no
    task sorts all new keys.
    """
    buckets = 64
    first = events.groupBy("merge_key").agg(F.min("seq").alias("first_seq"))
    known = stored.select(F.col("merge_key").alias("known"))
    new = first.join(known, F.col("merge_key").eqNullSafe(F.col("known")), "left_anti").withColumn("bucket", F.pmod(F.xxhash64("merge_key"), F.lit(buckets)))
    counts = new.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))  # one row
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("first_seq", "merge_key"))
    before = F.aggregate(F.filter("counts", lambda c: c["bucket"] < F.col("bucket")), F.lit(0).cast("long"), lambda n, c: n + c["n"])
    ranked = new.withColumn("rank", rank).crossJoin(F.broadcast(counts))
    if top is None:
        ranked = ranked.crossJoin(F.broadcast(stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))))
    else:
        ranked = ranked.withColumn("top", F.lit(top).cast("long"))
    return ranked.select("merge_key", (F.col("top") + before + F.col("rank")).alias("new_id"))


def merge_aliases(stored: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Aliases with events applied: the last target, status, chain and run; first seen stays, last seen is now."""
    hashes = small_side(events.select(F.xxhash64("requested_url").alias("key_hash")).distinct())
    old = stored.withColumn("seq", F.lit(-1).cast("long")).withColumn("key_hash", F.xxhash64("requested_url"))
    untouched = old.join(hashes, "key_hash", "left_anti").select(*stored.columns)
    new = events.withColumns({"first_seen_at": now, "last_seen_at": now})
    both = old.join(hashes, "key_hash", "left_semi").drop("key_hash").unionByName(new.select(*stored.columns, "seq"))
    last = F.max_by(F.struct("final_url", "status_code", "redirect_chain", "run_id"), "seq")
    folded = both.groupBy("requested_url").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), last.alias("l"))
    return untouched.unionByName(folded.select("requested_url", "l.final_url", "l.status_code", "l.redirect_chain", "first_seen_at", "last_seen_at", "l.run_id").select(*stored.columns))


def fold_runs(created: DataFrame, patches: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs as created, with partial updates (null leaves a field as it is; later seq wins) and their end."""
    fields = [c for c in created.columns if c not in ("run_id", "started_at", "finished_at")]
    given = [c for c in fields if c in patches.columns]
    late = patches.groupBy("run_id").agg(*[_last_known(c).alias(f"new_{c}") for c in given])
    ends = finished.groupBy("run_id").agg(F.max("finished_at").alias("new_finished_at"))
    out = created.join(late, "run_id", "left").join(ends, "run_id", "left")
    new = {c: F.coalesce(f"new_{c}", c) for c in given} | {"finished_at": F.coalesce("new_finished_at", "finished_at")}
    return out.withColumns(new).select(*created.columns)


def merge_overrides(stored: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Per domain the latest override; enabled unless said otherwise."""
    old = stored.withColumn("seq", F.lit(-1).cast("long"))
    new = events.withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("updated_at", now)
    both = old.unionByName(new.select(*old.columns))
    others = [c for c in stored.columns if c != "domain"]
    return both.groupBy("domain").agg(F.max_by(F.struct(*others), "seq").alias("l")).select("domain", "l.*").select(*stored.columns)


def url_holds(column: str, part: str) -> Column:
    """Does a URL contain part? Letter case does not count; % and _ in part are wildcards; null contains nothing."""
    return F.coalesce(F.col(column).ilike(f"%{part}%"), F.lit(False))


def delete_like(pages: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """(pages whose URL does not contain part, one row with the number deleted); see url_holds."""
    hit = url_holds("final_url", part)
    return pages.filter(~hit), pages.agg(F.count_if(hit).alias("deleted"))


def patch(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored with the columns of changes set where they have a row for the key. Rows without one stay in place."""
    new = [c for c in changes.columns if c != key]
    hashes = small_side(changes.select(F.xxhash64(key).alias("key_hash")).distinct())
    marked = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in new], F.lit(True).alias("has_change"))
    hashed = stored.withColumn("key_hash", F.xxhash64(key))
    out = hashed.join(hashes, "key_hash", "left_semi").join(marked, key, "left")
    out = out.withColumns({c: F.when(F.col("has_change"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in new}).select(*stored.columns)
    return hashed.join(hashes, "key_hash", "left_anti").select(*stored.columns).unionByName(out)
