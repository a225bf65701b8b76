"""Random inputs against plain Python models of the same rules."""

import json
import random
import re
import urllib.parse

from helpers import column
from pyspark.sql import functions as F

from stackroom.functions import naming, payload, text

# what a browser's trim() removes
SPACE = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ALPHABET = "ab.,/-7 Éß日😀%_+!~*'()&=?#" + SPACE + "\u200b\u0085\u180e"


def strings(seed, count=400):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(12))) for _ in range(count)]


def test_lists(spark):
    values = strings(1)
    wanted = [[part.strip(SPACE) for part in v.split(",") if part.strip(SPACE)] for v in values]
    assert column(spark, values, text.parse_list) == wanted


def test_uri_encoding(spark):
    values = strings(2)
    assert column(spark, values, text.encode_uri_component) == [urllib.parse.quote(v, safe="!~*'()") for v in values]


def test_titles(spark):
    values = strings(3)
    assert column(spark, values, naming.title_of_file) == [re.sub(r"\.[^/.]+\Z", "", v) for v in values]
    names = ["uploads/" + v for v in values]
    assert column(spark, names, naming.title_of_object) == [re.sub(r"^[0-9]+-", "", v) for v in values]


def json_value(draw, depth=0):
    kind = draw.randrange(7 if depth < 3 else 5)
    if kind == 0:
        return None
    if kind == 1:
        return draw.random() < 0.5
    if kind == 2:
        return draw.choice([0, -1, 7, 1.5, 12345678901, 1e-7])
    if kind < 5:
        return draw.choice(["", "x", 'q"\\', "é\n", "]", "},{", '",'])
    if kind == 5:
        return [json_value(draw, depth + 1) for _ in range(draw.randrange(3))]
    return {draw.choice("abc"): json_value(draw, depth + 1) for _ in range(draw.randrange(3))}


def bodies(seed, count=1500):
    """JSON texts, half of them damaged by one random edit."""
    draw = random.Random(seed)
    for _ in range(count):
        body = json.dumps(json_value(draw), ensure_ascii=draw.random() < 0.5)
        if draw.random() < 0.5:
            at = draw.randrange(len(body) + 1)
            body = body[:at] + draw.choice(["", " ", ",", "]", "[", "}", "{", '"', "1", "x", ":", "\\", "],["]) + body[
                at + draw.randrange(2) :
            ]
        yield body


def is_json(body):
    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(body, parse_constant=refuse)
        return True
    except ValueError:
        return False


def test_bodies(spark):
    texts = list(bodies(4))
    table = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    parsed = payload.with_payload(table).orderBy("i").select(F.to_json(payload.body(F.col("payload"))))
    for body, row in zip(texts, parsed.collect(), strict=True):
        assert (row[0] is not None) == is_json(body), body
        if row[0] is not None:
            assert json.loads(row[0]) == json.loads(body), body
