from helpers import at, catalog, rows, users
from pyspark.sql import functions as F

from stackroom.operators import gate, ingest
from stackroom.sources.outcomes import read_outcomes, write_outcomes

STAFF = {"ann": '{"maintainer":true}', "bob": '{"maintainer":"true"}', "cat": "{}"}


def requests(spark, *table):
    """(header, caller, body) with ids in order."""
    numbered = [(i, at(i), *row) for i, row in enumerate(table)]
    return spark.createDataFrame(
        numbered, "request_id int, issued_at timestamp, auth_header string, caller_uid bigint, body string"
    )


def statuses(gated):
    return [row.status for row in gated.orderBy("request_id").select("status").collect()]


def test_order_of_the_checks(spark):
    table = requests(
        spark,
        (None, 0, "{bad"),
        ("Basic x", 0, '{"files":[]}'),
        ("bearer t", 0, '{"files":[]}'),
        ("Bearer t", None, "{bad"),
        ("Bearer t", 99, '{"files":[]}'),
        ("Bearer t", 1, "{bad"),
        ("Bearer t", 2, '{"files":[]}'),
        ("Bearer t", 0, "{bad"),
        ("Bearer t", 0, '{"files":[]}'),
    )
    gated = gate.gate_uploads(table, users(spark, **STAFF))
    assert statuses(gated) == [401, 401, 401, 500, 500, 403, 403, 500, 200]
    assert gate.accepted(gated).count() + gate.rejected(gated).count() == table.count()


def test_manifest_bodies(spark):
    bodies = [
        "{}", "null", "5", "{bad", None, '{"files":null}', '{"files":"x"}', '{"files":[]}', '{"files":[5]}',
        '{"files":{}}', '{"files":[]} x',
    ]
    gated = gate.gate_uploads(requests(spark, *[("Bearer t", 0, b) for b in bodies]), users(spark, **STAFF))
    assert statuses(gated) == [400, 500, 400, 500, 500, 400, 400, 200, 200, 400, 500]


def test_edit_bodies(spark):
    bodies = [
        "{}", '{"title":null}', '{"title":5}', '{"categories":[]}', '{"categories":"x"}', "{bad", "null", "5", "[]",
        '{"tikakar":["a",null]}', '{"tikakar":[1]}', '{"other":5}',
    ]
    table = requests(spark, *[("Bearer t", 0, b) for b in bodies]).withColumn("target_id", F.lit("1"))
    gated = gate.gate_edits(table, users(spark, **STAFF), catalog(spark, {"id": "1"}))
    assert statuses(gated) == [200, 200, 422, 200, 422, 500, 500, 200, 200, 200, 422, 200]


def test_missing_target_is_told_before_wrong_types(spark):
    table = requests(spark, ("Bearer t", 0, '{"title":5}'), ("Bearer t", 0, "{}")).withColumn("target_id", F.lit("9"))
    assert statuses(gate.gate_edits(table, users(spark, **STAFF), catalog(spark, {"id": "1"}))) == [404, 404]
    assert statuses(gate.gate_edits(table, users(spark, **STAFF))) == [422, 200]


def test_lookup_tables_that_repeat_their_rows_multiply_nothing(spark):
    twice = lambda frame: frame.unionByName(frame)
    people, documents = users(spark, **STAFF), catalog(spark, {"id": "1"})
    calls = requests(spark, *[("Bearer t", i % 4, "{}") for i in range(20)]).withColumn("target_id", F.lit("1"))
    once = gate.gate_edits(calls, people, documents)
    doubled = gate.gate_edits(calls, twice(people), twice(documents))
    assert rows(doubled, "request_id", "status") == rows(once, "request_id", "status")
    assert gate.accepted(doubled).count() + gate.rejected(doubled).count() == 20
    asked = spark.createDataFrame([(1, "ann@example.com"), (2, None)], "request_id int, email string")
    shared = twice(people).unionByName(people.withColumn("uid", F.lit(7).cast("bigint")))
    assert rows(gate.user_by_email(asked, shared), "request_id", "uid") == [(1, 0), (2, None)]


def test_a_caller_whose_rows_disagree_is_no_maintainer(spark):
    people = users(spark, **STAFF)
    odd = people.unionByName(people.where("uid = 2").withColumn("uid", F.lit(0).cast("bigint")))
    calls = requests(spark, ("Bearer t", 0, '{"files":[]}'))
    assert statuses(gate.gate_uploads(calls, odd)) == [403]


def test_grants(spark):
    bodies = [
        "{}", '{"email":""}', '{"email":null}', '{"email":0}', '{"email":5}', '{"email":"cat@example.com"}',
        '{"email":"nobody@example.com"}', '{"email":"Cat@example.com"}',
    ]
    gated = gate.gate_grants(requests(spark, *[("Bearer t", 0, b) for b in bodies]), users(spark, **STAFF))
    assert statuses(gated) == [400, 400, 400, 400, 500, 200, 500, 500]
    assert rows(gate.accepted(gated), "email", "uid") == [("cat@example.com", 2)]


def test_outcomes_are_written_in_one_pass_and_read_by_folder(spark, tmp_path):
    bodies = ['{"files":[{"fileName":"a.pdf"}]}', "{bad", "{}", '{"files":[]}']
    gated = gate.gate_uploads(requests(spark, *[("Bearer t", 0, b) for b in bodies]), users(spark, **STAFF))
    path = str(tmp_path / "outcomes")
    for _ in range(2):
        write_outcomes(gated, path, 0)
    stored = read_outcomes(spark, path)
    assert rows(stored, "request_id", "status", "reason") == rows(gated, "request_id", "status", "reason")
    good = gate.accepted(stored)
    assert rows(ingest.manifest_files(good), "request_id", "file_name") == [(0, "a.pdf")]
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    assert rows(gate.rejected(stored), "request_id", "body") == [(1, "{bad"), (2, "{}")]
