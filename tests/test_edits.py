from helpers import at, catalog, rows

from stackroom.functions.payload import with_payload
from stackroom.operators import browse, edits


def library(spark):
    return catalog(
        spark,
        {"id": "1", "title": "One", "url": "u", "writer": "W", "categories": ["a"], "tikakar": ["t"],
         "description": "d", "created_at": at(), "updated_at": at(5)},
        {"id": "2", "title": "Two", "url": "u"},
    )


def accepted(spark, *table):
    numbered = [(i, at(100 + second), target, body) for i, (target, second, body) in enumerate(table)]
    return with_payload(
        spark.createDataFrame(numbered, "request_id int, ts timestamp, target_id string, body string")
    )


def test_empty_body_changes_the_time_only(spark):
    before = library(spark)
    after = edits.edits_apply(before, accepted(spark, ("1", 0, "{}")))
    assert rows(after.drop("updated_at")) == rows(before.drop("updated_at"))
    assert rows(after, "id", "updated_at") == [("1", at(100)), ("2", None)]


def test_absent_null_and_value(spark):
    body = '{"title":null,"writer":"V","categories":[]}'
    after = edits.edits_apply(library(spark), accepted(spark, ("1", 0, body)))
    assert rows(after.where("id = '1'"), "title", "writer", "categories", "tikakar", "description") == [
        (None, "V", (), ("t",), "d")
    ]


def test_each_field_takes_the_last_edit_that_has_it(spark):
    after = edits.edits_apply(
        library(spark),
        accepted(
            spark,
            ("1", 9, '{"writer":null}'),
            ("1", 1, '{"title":"early","writer":"early"}'),
            ("1", 5, '{"title":"late"}'),
            ("1", 5, '{"title":"same time, later request"}'),
            ("1", 20, "{}"),
        ),
    )
    assert rows(after.where("id = '1'"), "title", "writer", "updated_at") == [
        ("same time, later request", None, at(120))
    ]


def test_overlay_leaves_times_alone_and_ignores_unknown_documents(spark):
    table = accepted(spark, ("1", 0, '{"title":"new"}'), ("9", 0, '{"title":"lost"}'))
    after = edits.edit_overlay(library(spark), table)
    assert rows(after, "id", "title", "updated_at") == [("1", "new", at(5)), ("2", "Two", None)]


def test_form_round_trip(spark):
    forms = spark.createDataFrame([("1", " a, ,b\u00a0", "")], "id string, categories string, tikakar string")
    assert rows(edits.edit_normalize(forms)) == [("1", ("a", "b"), ())]
    normal = edits.edit_normalize(browse.edit_form(library(spark)))
    assert rows(normal, "id", "categories", "tikakar") == [("1", ("a",), ("t",)), ("2", (), ())]
