"""Every query, as a function of a session and a folder of tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from stackroom.functions import payload as P
from stackroom.functions.naming import viewer_link
from stackroom.operators import browse, edits, gate, ingest, reconcile, roles, saved
from stackroom.operators.skew import lookup_join, one_row
from stackroom.plans import sql, views
from stackroom.schemas import CATALOG
from stackroom.session import kept, new_run_dir, prepare
from stackroom.sources import listing, title_index
from stackroom.sources.catalog import append_batch, read_catalog
from stackroom.sources.objects import read_inventory
from stackroom.sources.outcomes import read_outcomes, write_outcomes
from stackroom.sources.snapshots import read_snapshot, save_keyed, split_snapshot, write_snapshot
from stackroom.sources.store import list_objects, put_objects
from stackroom.streaming import backfill as backfill_runs
from stackroom.streaming import saved_state as saved_state_runs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SEARCH_TERM = "É"
FLAGSHIP_TERM = "the"
READER = 7  # whose list the flagged pages show
AS_OF = dt.datetime(2024, 6, 1)
PAGE, SLICES = 50, 64  # documents of a page, slices of the stored listing


class Library:
    """The derived input tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    @property
    def catalog(self) -> DataFrame:
        return views.catalog(self.table("documents"))

    @property
    def contents(self) -> DataFrame:
        """The content table as stored, bucketed by address, one row each."""
        return self.stored("contents", lambda: views.contents(self.table("documents")), ["url"], fold=True)

    def stored(self, name: str, build: Callable[[], DataFrame], key: list[str], fold: bool = False) -> DataFrame:
        """A table that is there before a query, bucketed by its key."""

        def save() -> DataFrame:
            path = self.run_dir(name)
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            return save_keyed(build(), path.rpartition("/")[2].replace("-", "_"), path, key, buckets, fold)

        return kept(self.spark, f"{name} of {self.sf_dir}", save)

    @property
    def bucket(self) -> DataFrame:
        """Every object of the listing, put into a store of its own; gives the store's listing."""

        def fill() -> DataFrame:
            root = self.run_dir("bucket")
            put_objects(self.all_objects.withColumn("content", F.lit(None).cast("binary")), root)
            return list_objects(self.spark, root)

        return kept(self.spark, f"bucket of {self.sf_dir}", fill)

    @property
    def all_objects(self) -> DataFrame:
        return views.objects(*[self.table(name) for name in ("documents", "pages", "region", "nation")])

    @property
    def objects(self) -> DataFrame:
        """The listing, as an inventory table of the object store."""
        path = self.run_dir("inventory")
        views.inventory(self.all_objects).write.parquet(path)
        return read_inventory(self.spark, path)

    @property
    def users(self) -> DataFrame:
        return views.users(self.table("customer"))

    @property
    def staged(self) -> DataFrame:
        return views.staged(self.table("lineitem"))

    @property
    def saved_events(self) -> DataFrame:
        return views.saved_events(self.table("events"))

    @property
    def opens(self) -> DataFrame:
        return views.opens(self.table("events"))

    @property
    def members(self) -> DataFrame:
        """Keys of the saved table, for what needs no more than keys."""
        return saved.saved_fold(self.saved_events).where("saved").select(*saved.KEY)

    @property
    def saved(self) -> DataFrame:
        return views.saved(self.table("events"), self.table("documents"))

    @property
    def saved_table(self) -> DataFrame:
        """The saved table as stored, bucketed by its key."""
        return self.stored("saved", lambda: self.saved, list(saved.KEY))

    @property
    def saved_sizes(self) -> DataFrame:
        """The saved table's keys and sizes as stored, for what reads neither titles nor bytes."""
        return self.stored("saved_sizes", lambda: self.saved.select(*saved.KEY, "size"), list(saved.KEY))

    @property
    def puts(self) -> DataFrame:
        return views.puts(self.table("events"), self.table("documents"))

    @property
    def gated_uploads(self) -> DataFrame:
        return gate.gate_uploads(views.uploads(self.table("orders")), self.users)

    @property
    def gated_edits(self) -> DataFrame:
        return gate.gate_edits(views.edits(self.table("events")), self.users, self.catalog)

    @property
    def good_edits(self) -> DataFrame:
        """Edits to apply; those of missing documents fall away in the join with the catalog."""
        return gate.accepted(gate.gate_edits(views.edits(self.table("events")), self.users))

    @property
    def gated_grants(self) -> DataFrame:
        return gate.gate_grants(views.grants(self.table("orders")), self.users)

    @property
    def files(self) -> DataFrame:
        return ingest.manifest_files(gate.accepted(self.gated_uploads))

    @property
    def windowed(self) -> DataFrame:
        matches = ingest.upload_match_first(self.staged, ingest.upload_targets(self.files))
        put_at = F.timestamp_add("second", F.col("delay_seconds"), F.col("issued_at"))
        return ingest.upload_window(matches, put_at)

    @property
    def wanted(self) -> DataFrame:
        """Every document that somebody opens, with its address."""
        documents = one_row(self.catalog.select("id", "created_at", "title", "url"), ["id"])
        return lookup_join(self.opens, documents.drop("created_at"), ["id"], how="inner")

    def run_dir(self, name: str) -> str:
        return new_run_dir(self.spark, name)


def query(build: Callable[[Library], DataFrame]) -> Query:
    """Register a query under its function's name."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(build(Library(prepare(spark), sf_dir)))

    QUERIES[build.__name__] = run
    return run


def flat(rows: DataFrame) -> DataFrame:
    """Plain result columns: lists as joined text, times without zone, bytes as size and
    digest, open JSON as text."""
    columns = []
    for column in rows.schema:
        value = F.col(column.name)
        if isinstance(column.dataType, T.ArrayType):
            value = F.array_join(value, ", ", "")
        elif isinstance(column.dataType, T.TimestampType):
            value = value.cast("timestamp_ntz")
        elif isinstance(column.dataType, T.VariantType):
            value = F.to_json(value)
        elif isinstance(column.dataType, T.BinaryType):
            columns.append(F.octet_length(value).cast("bigint").alias(f"{column.name}_bytes"))
            value, name = F.md5(value), f"{column.name}_md5"
            columns.append(value.alias(name))
            continue
        columns.append(value.alias(column.name))
    return rows.select(*columns)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest titles that hold a term, with one reader's saved flag: the first page."""
    library = Library(prepare(spark), sf_dir)
    found = browse.catalog_search(library.catalog.select("id", "title", "url", "created_at"), FLAGSHIP_TERM, limit=20)
    return flat(browse.catalog_recent(saved.saved_flag_for(found, library.members, READER)))


# --- browsing ------------------------------------------------------------------


@query
def catalog_recent(lib: Library) -> DataFrame:
    return browse.catalog_recent(lib.catalog)


@query
def catalog_search(lib: Library) -> DataFrame:
    return browse.catalog_search(lib.catalog, SEARCH_TERM)


@query
def catalog_search_flagged(lib: Library) -> DataFrame:
    found = browse.title_matches(lib.catalog.select("id", "title", "url", "created_at"), FLAGSHIP_TERM)
    return browse.catalog_recent(saved.saved_flag_for(found, lib.members, READER))


@query
def catalog_display(lib: Library) -> DataFrame:
    return browse.catalog_display(lib.catalog)


@query
def object_listing(lib: Library) -> DataFrame:
    return browse.object_listing(lib.bucket)


@query
def edit_form(lib: Library) -> DataFrame:
    return browse.edit_form(lib.catalog)


@query
def edit_normalize(lib: Library) -> DataFrame:
    return edits.edit_normalize(browse.edit_form(lib.catalog))


@query
def download_export(lib: Library) -> DataFrame:
    return browse.download_export(lib.catalog)


@query
def viewer_links(lib: Library) -> DataFrame:
    return lib.table("pages").select("page_id", viewer_link(F.col("url")).alias("viewer_url"))


@query
def point_lookup(lib: Library) -> DataFrame:
    wanted = lib.table("labels").select(F.col("doc_id").cast("string").alias("id"))
    return browse.lookup_many(lib.catalog, wanted)


@query
def lookup_few(lib: Library) -> DataFrame:
    """The documents of a handful of ids, from a table with Bloom filters."""

    def store() -> str:
        path = lib.run_dir("by_id")
        listing.write_by_id(lib.catalog, path, int(lib.spark.conf.get("spark.sql.shuffle.partitions")))
        return path

    path = kept(lib.spark, f"by_id of {lib.sf_dir}", store)
    ids = [row.id for row in lib.table("region").select(F.col("r_regionkey").cast("string").alias("id")).collect()]
    return listing.read_by_id(lib.spark, path, ids)


@query
def catalog_search_indexed(lib: Library) -> DataFrame:
    """Search in the listing by the index of titles."""

    def store() -> str:
        path = lib.run_dir("title_index")
        title_index.index_titles(lib.catalog, path, 0)
        return path

    path = kept(lib.spark, f"title_index of {lib.sf_dir}", store)
    return browse.catalog_recent(title_index.find_titles(lib.catalog, path, FLAGSHIP_TERM))


@query
def catalog_page(lib: Library) -> DataFrame:
    """The third page of the listing, found behind the last row of the second."""

    def store() -> str:
        path = lib.run_dir("listing")
        listing.write_listing(lib.catalog, path, SLICES)
        return path

    path, after = kept(lib.spark, f"listing of {lib.sf_dir}", store), None
    for _ in range(2):
        last = listing.page(lib.spark, path, PAGE, after).select("created_at", "id").tail(1)
        after = tuple(last[0]) if last else after
    return listing.page(lib.spark, path, PAGE, after)


@query
def snapshot_split(lib: Library) -> DataFrame:
    """The good rows of a snapshot into which half a line more was written for each document."""
    path = lib.run_dir("snapshot_split")
    write_snapshot(lib.catalog, path)
    broken = lib.catalog.select(F.concat(F.lit('{"id": "'), "id", F.lit('", "title": ')).alias("value"))
    broken.write.mode("append").text(path)
    good, damaged = split_snapshot(lib.spark, path, CATALOG, lib.run_dir("split"))
    counts = damaged.groupBy(F.get_json_object(F.concat("line", F.lit("0}")), "$.id").alias("id")).agg(F.count("*").alias("damaged"))
    return good.select("id", "title", "created_at").join(counts, "id")


@query
def is_empty(lib: Library) -> DataFrame:
    lists = {
        "library": lib.catalog,
        "found": browse.title_matches(lib.catalog, FLAGSHIP_TERM),
        "not found": browse.title_matches(lib.catalog, "%"),
    }
    answers = [browse.is_empty(rows).withColumn("list", F.lit(name)) for name, rows in lists.items()]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


@query
def snapshot_json(lib: Library) -> DataFrame:
    path = lib.run_dir("snapshot_json")
    write_snapshot(lib.catalog, path)
    return browse.catalog_recent(read_snapshot(lib.spark, path, CATALOG))


# --- requests ------------------------------------------------------------------


@query
def request_gate(lib: Library) -> DataFrame:
    gated = {"upload": lib.gated_uploads, "edit": lib.gated_edits, "grant": lib.gated_grants}
    parts = [
        rows.select(F.lit(kind).alias("kind"), "request_id", "status", "reason") for kind, rows in gated.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def upload_register(lib: Library) -> DataFrame:
    return ingest.upload_register(lib.files)


@query
def upload_append(lib: Library) -> DataFrame:
    """Registered, appended, appended again under another number, and listed."""
    path = lib.run_dir("catalog")
    for batch in (0, 1):
        append_batch(ingest.upload_register(lib.files), path, batch)
    return browse.catalog_recent(read_catalog(lib.spark, path))


@query
def request_outcomes(lib: Library) -> DataFrame:
    """The reject table of the upload requests, as stored."""
    path = lib.run_dir("outcomes")
    write_outcomes(lib.gated_uploads.select("request_id", "status", "reason"), path, 0)
    return gate.rejected(read_outcomes(lib.spark, path)).select("request_id", "status", "reason")


@query
def upload_files_rejected(lib: Library) -> DataFrame:
    return lib.files.where("file_status <> 200").select("request_id", "pos", "file_status")


@query
def upload_targets_only(lib: Library) -> DataFrame:
    return ingest.upload_targets(lib.files)


@query
def pdf_only(lib: Library) -> DataFrame:
    return ingest.pdf_only(ingest.upload_targets(lib.files)).select("request_id", "pos", "file_name")


@query
def upload_match_first(lib: Library) -> DataFrame:
    matches = ingest.upload_match_first(lib.staged, ingest.upload_targets(lib.files))
    return matches.select("request_id", "file_key", "file_name", "pos", "storage_path")


@query
def upload_window(lib: Library) -> DataFrame:
    return lib.windowed.select("request_id", "file_key", "put_at", "expires_at", "in_time", "type_ok")


@query
def upload_content(lib: Library) -> DataFrame:
    """Put at their paths in a store, and read back from there."""
    root = lib.run_dir("uploads")
    put = put_objects(ingest.upload_content(lib.windowed, lib.staged), root, "storage_path")
    stored = list_objects(lib.spark, root, content=True).select(F.col("name").alias("storage_path"), "content")
    found = put.join(stored, "storage_path")
    return found.select("storage_path", "content_type", "content", "put_at", "file_key")


# --- the same in SQL -----------------------------------------------------------


def _sql(lib: Library, statement: str) -> DataFrame:
    """A statement over the library's views, by the functions made for SQL users."""
    views_ = {
        "catalog": lib.catalog, "objects": lib.objects, "requests": views.uploads(lib.table("orders")), "users": lib.users,
    }
    for name, rows in views_.items():
        rows.createOrReplaceTempView(f"library_{name}")
    sql.create_functions(lib.spark, **{name: f"library_{name}" for name in views_})
    return lib.spark.sql(statement)


@query
def sql_search(lib: Library) -> DataFrame:
    return _sql(lib, f"SELECT * FROM find_titles('{FLAGSHIP_TERM}') ORDER BY created_at DESC, id DESC")


@query
def sql_object_listing(lib: Library) -> DataFrame:
    return _sql(lib, "SELECT * FROM uploaded_objects()")


@query
def sql_upload_gate(lib: Library) -> DataFrame:
    return _sql(lib, "SELECT 'upload' AS kind, request_id, status, reason FROM gated_uploads()")


@query
def sql_upload_register(lib: Library) -> DataFrame:
    return _sql(lib, "SELECT * FROM registered_uploads()")


# --- edits ---------------------------------------------------------------------


@query
def edits_apply(lib: Library) -> DataFrame:
    return edits.edits_apply(lib.catalog, lib.good_edits)


@query
def edit_overlay(lib: Library) -> DataFrame:
    return browse.catalog_recent(edits.edit_overlay(lib.catalog, lib.good_edits))


@query
def edits_rejected(lib: Library) -> DataFrame:
    return edits.edits_rejected(lib.gated_edits).select("request_id", "target_id")


# --- saved copies --------------------------------------------------------------


@query
def saved_ids(lib: Library) -> DataFrame:
    return saved.saved_ids(lib.members)


@query
def saved_flag(lib: Library) -> DataFrame:
    return saved.saved_flag(lib.opens.select(*saved.KEY).distinct(), lib.members)


@query
def saved_fold(lib: Library) -> DataFrame:
    return saved.saved_fold(lib.saved_events)


@query
def saved_upsert(lib: Library) -> DataFrame:
    return saved.saved_upsert(lib.saved_table, lib.puts, lib.contents)


@query
def saved_delete(lib: Library) -> DataFrame:
    return saved.saved_delete(lib.saved_table, lib.opens)


@query
def saved_set_add(lib: Library) -> DataFrame:
    return saved.saved_set_add(lib.members, lib.opens)


@query
def saved_set_remove(lib: Library) -> DataFrame:
    return saved.saved_set_remove(lib.members, lib.opens)


@query
def saved_set_toggle(lib: Library) -> DataFrame:
    return saved.saved_set_toggle(lib.members, lib.opens)


@query
def content_fetch(lib: Library) -> DataFrame:
    tables = [lib.table(name) for name in ("documents", "pages", "events")]
    return saved.content_fetch(views.wishes(*tables), lib.contents)


@query
def content_store(lib: Library) -> DataFrame:
    return saved.content_store(lib.wanted, lib.contents)


@query
def content_resolve(lib: Library) -> DataFrame:
    return saved.content_resolve(lib.opens, lib.catalog, lib.saved_sizes).drop("ts")


# --- roles ---------------------------------------------------------------------


@query
def role_label(lib: Library) -> DataFrame:
    return roles.role_label(lib.users)


@query
def user_by_email(lib: Library) -> DataFrame:
    email = P.string_value(P.body_field(F.col("payload"), "email"))
    requests = P.with_payload(views.grants(lib.table("orders"))).select("request_id", email.alias("email"))
    return gate.user_by_email(requests, lib.users)


@query
def role_grant(lib: Library) -> DataFrame:
    return roles.role_grant(lib.users, gate.accepted(lib.gated_grants))


@query
def grant_messages(lib: Library) -> DataFrame:
    return roles.grant_messages(gate.accepted(lib.gated_grants))


# --- storage and catalog -------------------------------------------------------


@query
def backfill(lib: Library) -> DataFrame:
    return reconcile.backfill(lib.objects, lib.catalog, AS_OF)


@query
def backfill_count(lib: Library) -> DataFrame:
    """Counted while the rows are registered."""
    rows = reconcile.backfill(lib.objects, lib.catalog, AS_OF)
    processed = reconcile.register(rows, lib.run_dir("registered"), 0)
    return lib.spark.range(1).select(F.lit(processed).cast("bigint").alias("processed"))


@query
def backfill_stream(lib: Library) -> DataFrame:
    path = lib.run_dir("backfill")
    streams = [views.stream(lib.spark, lib.sf_dir, name) for name in ("documents", "pages", "region", "nation")]
    rows, checkpoint = f"{path}/rows", f"{path}/checkpoint"
    backfill_runs.backfill_stream(views.objects(*streams), lib.catalog, rows, checkpoint, AS_OF).awaitTermination()
    return lib.spark.read.schema(CATALOG).parquet(rows)


@query
def saved_state_stream(lib: Library) -> DataFrame:
    checkpoint = lib.run_dir("saved_state")
    steps = views.saved_events(views.stream(lib.spark, lib.sf_dir, "events"))
    saved_state_runs.saved_state_stream(steps, checkpoint).awaitTermination()
    return saved_state_runs.members(lib.spark, checkpoint)
