from helpers import rows, users
from pyspark.sql import functions as F

from stackroom.operators import roles

PEOPLE = {
    "ann": '{"maintainer":true}', "bob": '{"maintainer":"true"}', "cat": '{"maintainer":false,"beta":1}',
    "dan": '{"maintainer":null}', "eve": "{}", "fay": '{"maintainer":1}', "gus": '{"maintainer":""}',
}


def test_label_takes_any_truthy_claim(spark):
    labels = {row.display_name: row.role for row in roles.role_label(users(spark, **PEOPLE)).collect()}
    assert [name for name, role in labels.items() if role == "Maintainer"] == ["ann", "bob", "fay"]


def test_grant_replaces_all_claims(spark):
    grants = spark.createDataFrame([(2,), (2,), (99,)], "uid bigint")
    after = roles.role_grant(users(spark, **PEOPLE), grants).select("uid", F.to_json("claims").alias("claims"))
    claims = dict(rows(after))
    assert len(claims) == len(PEOPLE)
    assert claims[2] == '{"maintainer":true}'
    assert claims[1] == '{"maintainer":"true"}'


def test_message(spark):
    grants = spark.createDataFrame([(1, "a@b")], "request_id int, email string")
    assert rows(roles.grant_messages(grants), "message") == [("Successfully made a@b a maintainer.",)]
