"""Functions for SQL users: the same values and plans as the expressions they come from."""

import pytest
from helpers import column, rows
from pyspark.sql import functions as F

from stackroom.functions import naming as N
from stackroom.functions import text as X
from stackroom.plans import sql

TEXTS = [None, "", "a.b.pdf", "uploads/1700000000000-2024-x.pdf", "uploads/", " a , ,b,", "\u00a0x\ufeff", "https://a/b c!~*'()+\u00e9&=?", "blob:1", "%", "it's \\ =(x"]


@pytest.fixture(scope="module")
def created(spark):
    sql.create_functions(spark)
    return spark


@pytest.mark.parametrize("name", sorted(n for n, (declared, _, _) in sql.SCALARS.items() if declared.endswith(" STRING") and "," not in declared))
def test_text_functions_equal_their_expressions(created, name):
    build = sql.SCALARS[name][2]
    shown = F.to_json if name == "request_payload" else lambda c: c
    assert column(created, TEXTS, lambda v: shown(F.call_function(name, v))) == column(created, TEXTS, lambda v: shown(build(v)))


def test_a_call_plans_like_the_expression(created):
    table = created.createDataFrame([("a.b.pdf",)], "v string")
    table.createOrReplaceTempView("names")
    for call, expression in (("title_of_file(v)", N.title_of_file(F.col("v"))), ("viewer_link(v)", N.viewer_link(F.col("v")))):
        plans = [
            frame._jdf.queryExecution().optimizedPlan().canonicalized().toString()
            for frame in (created.sql(f"SELECT {call} AS x FROM names"), table.select(expression.alias("x")))
        ]
        assert plans[0] == plans[1]


def test_functions_with_other_arguments(created):
    assert created.sql("SELECT format_list(array('a', NULL, 'b')) x, format_list(array()) y, title_has('One', 'NE') z").first() == ("a, , b", "", True)
    assert created.sql("SELECT storage_path(timestamp '2024-05-01 00:00:00', 'a.pdf') x").first().x == "uploads/1714521600000-a.pdf"
    claims = created.sql("""SELECT j, holds_role(parse_json(j)) strict, shows_role(parse_json(j)) loose FROM VALUES
        ('{"maintainer":true}'), ('{"maintainer":"true"}'), ('{"maintainer":0}'), ('{}'), (NULL) AS t(j)""")
    assert sorted((r.strict, r.loose) for r in claims.collect()) == [(False, False), (False, False), (False, False), (False, True), (True, True)]


def test_text_that_looks_like_an_operator_stays_text(created):
    quoted = F.concat(F.lit("=(not(x) it's \\"), F.col("v"), F.lit("<(")) == F.lit("a")
    text = sql.sql_of(quoted)
    found = created.createDataFrame([("b",)], "v string").selectExpr(f"{text} AS x").first().x
    assert found is False and X.parse_list is sql.SCALARS["parse_list"][2]


def test_table_functions_need_their_views(spark):
    spark.createDataFrame([("uploads/1-a.pdf",), ("uploads/",), ("other",)], "name string").createOrReplaceTempView("some_objects")
    sql.create_functions(spark, objects="some_objects")
    assert rows(spark.sql("SELECT * FROM uploaded_objects()"), "id", "title") == [("uploads/1-a.pdf", "a.pdf")]
    with pytest.raises(Exception, match="no_such_view|UNRESOLVABLE|TABLE_OR_VIEW|ROUTINE_NOT_FOUND|cannot be found"):
        sql.create_functions(spark, catalog="no_such_view")
        spark.sql("SELECT * FROM find_titles('x')").collect()
