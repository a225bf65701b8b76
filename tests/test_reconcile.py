import datetime as dt

from helpers import catalog, rows

from stackroom.operators import reconcile
from stackroom.sources.catalog import read_catalog

AS_OF = dt.datetime(2024, 6, 1)
NAMES = ["uploads/", "uploads/1700000000000-a.b.pdf", "uploads/2024-x.pdf", "uploads/plain.pdf", "other/x.pdf", "uploads/known",
         "uploads/9223372036854775807-x.pdf", "uploads/99999999999999999999-y.pdf", "uploads/_draft.pdf", "uploads/.pdf",
         "uploads/_sub/2-b.pdf", "uploads/notes._COPYING_"]


def listing(spark):
    return spark.createDataFrame([(name,) for name in NAMES], "name string")


def test_backfill_registers_unknown_objects_once(spark):
    known = catalog(spark, {"id": "k", "gcs_path": "uploads/known"}, {"id": "l", "gcs_path": "uploads/known"})
    new = reconcile.backfill(listing(spark), known, AS_OF)
    assert rows(new, "gcs_path", "title", "created_at") == [
        ("uploads/.pdf", "", AS_OF),
        ("uploads/1700000000000-a.b.pdf", "a.b", dt.datetime(2023, 11, 14, 22, 13, 20)),
        ("uploads/2024-x.pdf", "x", dt.datetime(1970, 1, 1, 0, 0, 2, 24000)),
        ("uploads/9223372036854775807-x.pdf", "x", AS_OF),
        ("uploads/99999999999999999999-y.pdf", "y", AS_OF),
        ("uploads/_draft.pdf", "_draft", AS_OF),
        ("uploads/_sub/2-b.pdf", "_sub/2-b", AS_OF),
        ("uploads/notes._COPYING_", "notes", AS_OF),
        ("uploads/plain.pdf", "plain", AS_OF),
    ]
    assert rows(reconcile.backfill_count(new)) == [(9,)]
    assert reconcile.backfill(listing(spark), known.unionByName(new), AS_OF).isEmpty()
    assert new.columns == known.columns


def test_registering_counts_what_it_writes(spark, tmp_path):
    known = catalog(spark, {"id": "k", "gcs_path": "uploads/known"})
    new = reconcile.backfill(listing(spark), known, AS_OF)
    path = str(tmp_path / "catalog")
    assert reconcile.register(new.unionByName(new), path, 0) == 9
    assert rows(read_catalog(spark, path)) == rows(new)
    assert reconcile.register(new, path, 1) == 0
