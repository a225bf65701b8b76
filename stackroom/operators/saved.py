"""Users' saved copies: membership, content and the fold of save/remove/toggle steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stackroom.functions import wording as W
from stackroom.functions.naming import LOCAL_PREFIX
from stackroom.operators.skew import lookup_join, one_wide_row
from stackroom.session import written

KEY = ("user_id", "id")


def saved_ids(saved: DataFrame, user_id: int | None = None) -> DataFrame:
    """Distinct ids of the documents that one user has saved, as text; of all users as (user_id, id).

    Reads the key only.
    """
    text = F.col("id").cast("string").alias("id")
    if user_id is None:
        return saved.select("user_id", text).distinct()
    return saved.where(F.col("user_id") == user_id).select(text).distinct()


def saved_flag(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows (user_id, id, ...) with ``is_saved``: whether that user has saved that document.

    Tests the key only, not whether bytes are there.
    """
    flagged = lookup_join(rows, saved_ids(saved).withColumn("is_saved", F.lit(True)), KEY)
    return flagged.withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))


def saved_flag_for(catalog: DataFrame, saved: DataFrame, user_id: int) -> DataFrame:
    """Catalog rows as one user's list shows them, with ``is_saved``."""
    marked = saved_ids(saved, user_id).withColumn("is_saved", F.lit(True))
    return catalog.join(marked, "id", "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))


def content_fetch(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """Bytes of each distinct address; ``fetched`` is false where the store has nothing there.

    Wishes are folded to addresses first; whoever wished keeps pointing at the address.
    ``contents`` has one row for each address, as a table kept by :func:`save_keyed` has: bucketed by it,
    its bytes stay where they are.
    """
    urls = wanted.where(F.col("url").isNotNull()).select("url").distinct()
    found = contents.select("url", "content", F.lit(True).alias("fetched"))
    return urls.join(found, "url", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))


def content_store(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """Records to save, one per user and document; what cannot be fetched is left out.

    Repeated wishes are folded before any bytes are attached; of several addresses the
    first in order is taken.  Only bytes that somebody wishes are moved, once for each address,
    however many wish them.
    """
    once = wanted.groupBy(*KEY).agg(F.min(F.struct("title", "url")).alias("wish")).select(*KEY, "wish.title", "wish.url")
    return _with_bytes(once, contents)


def _with_bytes(once: DataFrame, contents: DataFrame) -> DataFrame:
    asked = once.where(F.col("url").isNotNull()).select("url").distinct()
    found = contents.select("url", "content").join(asked, "url", "left_semi")
    size = F.octet_length("content").cast("bigint").alias("size")
    return lookup_join(once, found, ["url"], "inner").select(*KEY, "title", "content", size)


def last_puts(puts: DataFrame) -> DataFrame:
    """The last put of each key, by ``(ts, seq)``: user_id, id, title, url."""
    last = F.max(F.struct("ts", "seq", "title", "url")).alias("put")
    return puts.groupBy(*KEY).agg(last).select(*KEY, "put.title", "put.url")


def saved_upsert(saved: DataFrame, puts: DataFrame, contents: DataFrame) -> DataFrame:
    """Next saved table: a put replaces the whole record of its key; the last put wins.

    A put names the address of its bytes.  Puts are folded by their key columns and
    written once (narrow), as both what goes and what comes is told from them; bytes are
    fetched for the last puts only.  A put whose bytes cannot be fetched changes nothing.
    """
    last = last_puts(puts).where(F.col("url").isNotNull())
    found = contents.select("url").join(last.select("url").distinct(), "url", "left_semi")
    last = written(lookup_join(last, found, ["url"], "inner").select(*last.columns), "puts")
    records = _with_bytes(last, contents).select(*saved.columns)
    return saved_delete(saved, last).unionByName(records)


def saved_delete(saved: DataFrame, keys: DataFrame) -> DataFrame:
    """Next saved table without these keys; a key that is not there changes nothing."""
    return saved.join(keys.select(*KEY).distinct(), list(KEY), "left_anti")


def saved_fold(events: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Membership after all steps, per user and document, as ``saved``.

    The last put or delete sets a key's membership and each later toggle flips
    it.  ``previous`` holds the keys that were saved before these events.  Order
    is ``(ts, seq)``.  Only aggregates that combine before the shuffle and a join
    that spreads hot keys are used, so no key's steps meet in one task.
    """
    # said here for both uses of the last sets, whose shuffle Spark can then share
    has_key = F.col("user_id").isNotNull() & F.col("id").isNotNull()
    steps = events.where(has_key & F.col("op").isin("put", "delete", "toggle"))
    sets = steps.where(F.col("op") != "toggle").select(*KEY, "ts", "seq", (F.col("op") == "put").alias("saved"))
    if previous is not None:
        before = previous.select(
            *KEY,
            F.lit(None).cast(events.schema["ts"].dataType).alias("ts"),
            F.lit(None).cast("bigint").alias("seq"),
            F.lit(True).alias("saved"),
        )
        sets = sets.unionByName(before)
    # NULL sorts first: earlier membership gives way to any put or delete
    last_set = (
        sets.groupBy(*KEY)
        .agg(F.max(F.struct("ts", "seq", "saved")).alias("last"))
        .select(*KEY, F.col("last.ts").alias("set_ts"), F.col("last.seq").alias("set_seq"), "last.saved")
    )

    toggles = steps.where(F.col("op") == "toggle").select(*KEY, "ts", "seq")
    is_later = (
        F.col("set_ts").isNull()
        | (F.col("ts") > F.col("set_ts"))
        | ((F.col("ts") == F.col("set_ts")) & (F.col("seq") > F.col("set_seq")))
    )
    flips = (
        lookup_join(toggles, last_set, KEY)
        .groupBy(*KEY)
        .agg((F.count_if(is_later) % 2 == 1).alias("flipped"))
    )
    start = F.coalesce("saved", F.lit(False))
    return last_set.join(flips, list(KEY), "full_outer").select(
        *KEY, (start != F.coalesce("flipped", F.lit(False))).alias("saved")
    )


def content_resolve(opens: DataFrame, catalog: DataFrame, saved: DataFrame) -> DataFrame:
    """Address from which each opened document is read, with the status line.

    The saved copy is used when there is a record *and* it has bytes, which its
    ``size`` tells.  A document that is not in the catalog cannot be opened.  One row for each
    opening, however often the catalog or the saved table repeats a row: of an id that occurs twice
    the row that comes first in the listing counts, of a saved record any that has bytes.
    """
    documents = one_wide_row(catalog.select("id", "created_at", "title", "url"), ["id"]).drop("created_at")
    copies = saved.where(F.col("size").isNotNull()).select(*KEY).distinct().withColumn("copy", F.lit(True))
    # titles, which may be long, are attached last and move once
    marked = lookup_join(opens, copies, KEY)
    resolved = lookup_join(marked, documents, ["id"], how="inner")
    local = F.col("copy").isNotNull()
    return resolved.select(
        *opens.columns,
        "title",
        F.when(local, F.concat_ws("/", F.lit(LOCAL_PREFIX), "user_id", "id"))
        .otherwise(F.col("url"))
        .alias("read_url"),
        F.concat(
            F.lit(W.READING), "title", F.when(local, F.lit(W.OFFLINE)).otherwise(F.lit(W.ONLINE))
        ).alias("status"),
    )


def saved_set_add(members: DataFrame, added: DataFrame) -> DataFrame:
    """Members plus the added; adding a member again changes nothing."""
    return members.union(added.select(*members.columns)).distinct()


def saved_set_remove(members: DataFrame, removed: DataFrame) -> DataFrame:
    return _by_side(members, removed).where("in_left and not in_right").select(*members.columns)


def saved_set_toggle(members: DataFrame, toggled: DataFrame) -> DataFrame:
    """Members that are not toggled plus toggled keys that are not members."""
    return _by_side(members, toggled).where("in_left <> in_right").select(*members.columns)


def _by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both sides with the side they occur on: one combined shuffle."""
    columns = left.columns
    sides = left.withColumn("on_left", F.lit(True)).unionByName(
        right.select(*columns).withColumn("on_left", F.lit(False))
    )
    return sides.groupBy(*columns).agg(
        F.bool_or("on_left").alias("in_left"), F.bool_or(~F.col("on_left")).alias("in_right")
    )
