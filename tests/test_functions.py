import urllib.parse

from helpers import at, column
from pyspark.sql import functions as F

from stackroom.functions import naming, payload, text


def test_title_of_file_strips_the_last_extension_only(spark):
    names = ["a.b.pdf", "noext", ".pdf", "f.", "x.d/file", "2024-x.pdf", "", "a.pdf\n", None]
    assert column(spark, names, naming.title_of_file) == [
        "a.b", "noext", "", "f.", "x.d/file", "2024-x", "", "a", None,
    ]


def test_title_of_object_keeps_the_extension(spark):
    names = [
        "uploads/1700000000000-2024-x.pdf",
        "uploads/2024-x.pdf",
        "uploads/1-uploads/x",
        "uploads/x.pdf",
        "uploads/uploads/7-x",
    ]
    assert column(spark, names, naming.title_of_object) == [
        "2024-x.pdf", "x.pdf", "uploads/x", "x.pdf", "uploads/7-x",
    ]


def test_upload_time(spark):
    names = ["uploads/1700000000123-x", "uploads/x", "uploads/-x", "uploads/" + "9" * 30 + "-x"]
    times = column(spark, names, lambda v: F.unix_millis(naming.upload_time(v)))
    assert times == [1700000000123, None, None, None]


def test_storage_path_url_and_expiry(spark):
    moment = F.lit(at()).cast("timestamp")
    assert column(spark, ["a b.pdf"], lambda v: naming.storage_path(moment, v)) == ["uploads/1714521600000-a b.pdf"]
    assert column(spark, ["a b&é.pdf"], lambda v: naming.Bucket("shelf", "https://host").url(v)) == ["https://host/shelf/a b&é.pdf"]
    assert column(spark, ["x"], lambda v: naming.expires_at(moment).cast("string")) == ["2024-05-01 00:15:00"]


def test_row_key_is_stable(spark):
    keys = column(spark, ["a", "a", "b"], lambda v: naming.row_key(v, F.lit(1)))
    assert keys[0] == keys[1] != keys[2]


def test_encode_uri_component(spark):
    values = ["https://a/b c!~*'()+é&=?", "+ %", "日本", "-_.", ""]
    wanted = [urllib.parse.quote(v, safe="!~*'()") for v in values]
    assert column(spark, values, text.encode_uri_component) == wanted


def test_viewer_link_leaves_local_copies_alone(spark):
    links = column(spark, ["blob:x", "Blob:x", None], naming.viewer_link)
    assert links == [None, naming.VIEWER_BASE + "Blob%3Ax", None]


def test_parse_list(spark):
    values = [" a , ,b,", "", ",", "\t\u00a0x\u3000", "\ufeff", "in  side", None]
    assert column(spark, values, text.parse_list) == [["a", "b"], [], [], ["x"], [], ["in  side"], None]


def test_format_list(spark):
    values = [[], None, ["a", None, "b"], ["x"]]
    assert column(spark, values, lambda v: text.format_list(v), "v array<string>") == ["", None, "a, , b", "x"]


def test_or_default(spark):
    assert column(spark, [None, "", " ", "x"], lambda v: text.or_default(v, "-")) == ["-", "-", " ", "x"]


def test_contains_text_is_literal_and_folds_case(spark):
    titles = ["100% x", "a_b", "École", "İstanbul", None]
    assert column(spark, titles, lambda v: text.contains_text(v, "%")) == [True, False, False, False, None]
    assert column(spark, titles, lambda v: text.contains_text(v, "_")) == [False, True, False, False, None]
    assert column(spark, titles, lambda v: text.contains_text(v, "É")) == [False, False, True, False, None]
    assert column(spark, titles, lambda v: text.contains_text(v, "İ")) == [False, False, False, True, None]
    assert column(spark, titles, lambda v: text.contains_text(v, "")) == [True, True, True, True, None]


def test_parse_body_takes_exactly_one_json_value(spark):
    bodies = ["{}", " 5 ", "null", "{bad", "", "{} x", "1,2", "1],[2", '1,"end"],[5', "NaN", None, '{"a":1,"a":2}']
    table = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    parsed = payload.with_payload(table).orderBy("i").select(F.to_json(payload.body(F.col("payload"))))
    parsed = [row[0] for row in parsed.collect()]
    assert parsed == ["{}", "5", "null", None, None, None, None, None, None, None, None, '{"a":2}']


def test_absent_null_and_value_stay_apart(spark):
    bodies = ['{"t":"x"}', '{"t":null}', "{}", "5", '{"t":5}']
    def given(v):
        return payload.field(F.parse_json(v), "t")

    assert column(spark, bodies, lambda v: given(v).isNotNull()) == [True, True, False, False, True]
    assert column(spark, bodies, lambda v: payload.is_json_null(given(v))) == [False, True, False, False, False]
    assert column(spark, bodies, lambda v: payload.string_value(given(v))) == ["x", None, None, None, None]


def test_string_list(spark):
    bodies = ["[]", '["a",null]', "[null]", "[1]", '"x"', "[[]]"]
    assert column(spark, bodies, lambda v: payload.string_list(F.parse_json(v))) == [[], ["a", None], [None], None, None, None]


def test_strict_and_truthy_claims(spark):
    claims = ["true", '"true"', "false", "null", None, "1", '""', "0", "[]", "{}", "0.5", "-0.0", '"false"']
    assert column(spark, claims, lambda v: payload.is_true(F.parse_json(v))) == [True] + [False] * 12
    assert column(spark, claims, lambda v: payload.is_truthy(F.parse_json(v))) == [
        True, True, False, False, False, True, False, False, True, True, True, False, True,
    ]


def test_is_array(spark):
    values = ["[]", "[null]", "[[]]", '"[]"', "{}", "null", "5", None]
    assert column(spark, values, lambda v: payload.is_array(F.parse_json(v))) == [True] * 3 + [False] * 5
