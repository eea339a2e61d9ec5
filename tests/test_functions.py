from __future__ import annotations

import base64
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidmatch.functions import ids, nested, numbers, status, text, vectors

LABELS = dict(
    title="T", brand="B", category="PC", product_type="PT", age_group="AG", color="C",
    gender="G", material="M", pattern="P", description="D",
)


def lits(values):
    return [F.lit(v).cast("string") for v in values]


def test_product_text_has_all_labels_in_order(one):
    got = one(text.product_text(*lits(LABELS.values())))
    assert got == (
        "Title: T\nBrand: B\nProduct Category: PC\nProduct Type: PT\nAge Group: AG\nColor: C\n"
        "Gender: G\nMaterial: M\nPattern: P\nDescription: D"
    )


def test_product_text_skips_null_and_empty_but_keeps_blank(one):
    values = dict(LABELS, brand="", age_group=None, gender=None, material=" ")
    got = one(text.product_text(*lits(values.values())))
    assert "Brand" not in got and "Age Group" not in got and "Gender" not in got
    assert "Material:  \n" in got


def test_identified_text(one):
    got = one(text.identified_text(*lits(["t", "d", "s", "c", None])))
    assert got == "Title: t\nDescription: d\nColor, Pattern, Style, Usage: s\nCategory: c"


@pytest.mark.parametrize(
    "title, video_id, wanted",
    [
        ("Running Shoes", "VID123", {"running", "shoes", "vid123"}),
        ("Nike-Air_Max 2024! #deal", "vid-001", {"nike-air_max", "2024", "deal", "vid-001"}),
        ("Wow WOW wow", "wow", {"wow"}),
        (None, "vid_456", {"vid_456"}),
        ("Cool Video", None, {"cool", "video"}),
        (None, None, set()),
        ("Été à la плаж 日本", None, {"été", "à", "la", "плаж", "日本"}),
    ],
)
def test_search_keywords(one, title, video_id, wanted):
    got = one(text.search_keywords(*lits([title, video_id])))
    assert set(got) == wanted and len(got) == len(wanted)


def test_search_tokens(one):
    assert one(text.search_tokens("  Red\tSHOES!  ")) == ["red", "shoes!"]
    assert one(text.search_tokens("Red shoes!", tokenize="regex")) == ["red", "shoes"]
    many = " ".join(f"w{i}" for i in range(50))
    assert len(one(text.search_tokens(many))) == 50 and len(one(text.search_tokens(many, 30))) == 30
    assert one(text.search_tokens("   ")) == []
    with pytest.raises(ValueError):
        text.search_tokens("a", tokenize="other")


@pytest.mark.parametrize(
    "uri, wanted",
    [
        ("gs://test-bucket/test/path.txt", ("test-bucket", "test/path.txt")),
        ("test-bucket/test/path.txt", ("test-bucket", "test/path.txt")),
        ("not-a-gcs-uri", None),
        ("test-bucket", None),
        ("gs://test-bucket", None),
        ("test-bucket/", None),
        ("gs://test-bucket/", None),
        (None, None),
    ],
)
def test_split_uri(one, uri, wanted):
    got = one(text.split_uri(F.lit(uri).cast("string")))
    assert (None if got is None else tuple(got)) == wanted


def test_normalize_customer_id(one):
    assert one(text.normalize_customer_id(F.lit("123-456"))) == "123456"
    assert one(text.normalize_customer_id(F.lit(77))) == "77"
    assert one(text.normalize_customer_id(F.lit(0))) == ""
    assert one(text.normalize_customer_id(F.lit("0"))) == "0"
    assert one(text.normalize_customer_id(F.lit(""))) == ""
    assert one(text.normalize_customer_id(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    "raw, wanted",
    [("purge", "PURGE"), ("PRESERVE", "PRESERVE"), ("x", "PRESERVE"), ("", "PRESERVE"), (None, "PRESERVE")],
)
def test_parse_strategy(one, raw, wanted):
    assert one(text.parse_strategy(F.lit(raw).cast("string"))) == wanted


def test_join_messages(one):
    arr = F.array(*lits(["b", None, "", "a", "b"]))
    assert one(text.join_messages(arr)) == "b; a"


def test_brand_prefix(one):
    title, brand = F.lit("ACME rocket"), F.lit("Acme")
    assert one(text.brand_at_start(title, brand)) is True
    assert one(text.brand_part(title, brand)) == "ACME"
    assert one(text.title_rest(title, brand)) == " rocket"
    assert one(text.brand_at_start(title, F.lit(""))) is False
    assert one(text.brand_part(title, F.lit("Other"))) == ""
    assert one(text.title_rest(title, F.lit(None).cast("string"))) == "ACME rocket"


def test_video_title(one):
    def run(*values):
        return one(text.video_title(*lits(values)))

    assert run("T", "gs://b/x.mp4", "v", "u") == "T"
    assert run("", "gs://b/x.mp4", "v", "u") == "x.mp4"
    assert run(None, None, "v", "u") == "v"
    assert run(None, "", "", "u") == "u"


def test_split_and_sort_ids(one):
    c = F.lit(" b , a,, a\t")
    assert one(text.split_ids(c)) == ["b", "a", "", "a"]
    assert one(text.split_ids(c, keep_blank=False)) == ["b", "a", "a"]
    assert one(text.split_ids(F.lit(""))) == []
    assert one(text.sorted_ids(F.array(*lits(["b", "a", "10"])))) == "10,a,b"


def test_keys_labels_and_messages(one):
    assert one(text.doc_key("prod_", F.lit(5))) == "prod_5"
    assert one(text.strip_key("prod_", F.lit("prod_prod_5"))) == "prod_5"
    assert one(text.strip_key("prod_", F.lit("x_prod_5"))) == "x_prod_5"
    assert one(text.name_with_id(F.lit("Shop"), F.lit(5))) == "Shop (5)"
    assert one(text.name_with_id(F.lit(None).cast("string"), F.lit(5))) == "5"
    assert one(text.failure_message("offer", F.lit("x"))) == "Fatal: x"
    assert one(text.failure_message("request", F.lit("x"))) == "Critical Worker Fail: x"


@settings(max_examples=25, deadline=None)
@given(names=st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=20))
def test_uuid5_equals_python(spark, names):
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    for row in frame.select("name", ids.uuid5(F.col("name")).alias("u")).collect():
        assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, row["name"]))


def test_video_uuid(one):
    none = F.lit(None).cast("string")
    assert one(ids.video_uuid(F.lit("123"), none, none)) == "123"
    wanted = str(uuid.uuid5(uuid.NAMESPACE_URL, "gs://test/test.mp4abc"))
    assert one(ids.video_uuid(none, F.lit("gs://test/test.mp4"), F.lit("abc"))) == wanted
    assert one(ids.video_uuid(none, F.lit("gs://test/test.mp4"), none)) is None
    assert one(ids.idp_uuid(F.lit("v"), F.lit(1))) != one(ids.idp_uuid(F.lit("v"), F.lit(2)))


def test_md5_hex(one):
    raw = b"test hash bytes"
    assert one(ids.md5_hex(F.lit(base64.b64encode(raw).decode()))) == raw.hex()


@pytest.mark.parametrize(
    "value, wanted",
    [("00:00:16.016", 16016), ("01:02:03", 3723000), ("00:00:12.5129", 12512), ("x", None), ("1:2", None), (None, None)],
)
def test_duration_ms(one, value, wanted):
    assert one(numbers.duration_ms(F.lit(value).cast("string"))) == wanted


def test_interval_ms_and_marks(one):
    assert one(numbers.interval_ms(F.expr("interval 10 seconds"))) == 10000
    assert one(numbers.interval_ms(F.expr("interval '1 02:03:04.5678' day to second"))) == 93784567
    assert str(one(numbers.mark_or_epoch(F.lit(None).cast("timestamp")).cast("string"))).startswith("0001-01-01")
    assert one(numbers.cutoff("2024-01-02 01:00:00").cast("string")) == "2024-01-01 23:00:00"
    assert one(F.date_format(numbers.now_seconds(), "SSSSSS")) == "000000"


def test_numbers(one):
    assert one(numbers.cpc_micros(F.lit(1.5))) == 1500000
    assert one(numbers.cpc_micros(F.lit(0.0))) is None
    assert one(numbers.cpc_micros(F.lit(None).cast("double"))) is None
    assert one(numbers.floor_zero(F.lit(-3))) == 0
    assert one(numbers.price_double(F.struct(F.lit("1.25").cast("decimal(18,4)").alias("value")))) == 1.25
    assert one(numbers.init_counter(F.lit(None).cast("long"))) == 0


def test_vectors(one):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(vectors.l2_normalize(v)) == [0.6, 0.8]
    assert one(vectors.l2_normalize(v, full_dim=2)) == [3.0, 4.0]
    assert one(vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(vectors.l2_distance(v, F.array(F.lit(0.0), F.lit(0.0)))) == 5.0
    assert one(vectors.l2_distance(v, F.array(F.lit(0.0)))) is None


def test_nested(one):
    none = F.lit(None).cast("array<string>")
    more = F.array(*lits(["b", "c", "d"]))
    assert one(nested.image_links(F.lit("a"), more)) == ["a", "b", "c"]
    assert one(nested.image_links(F.lit(""), more, None)) == ["b", "c", "d"]
    assert one(nested.image_links(F.lit(None).cast("string"), none)) == []
    assert one(nested.identified_count(none)) == 0
    built = one(nested.offers_map(F.array(*lits(["1", "2", "1"])), F.lit(5)))
    assert {k: tuple(v) for k, v in built.items()} == {"1": ("PENDING", 5, None), "2": ("PENDING", 5, None)}
    pushes = F.create_map(F.lit("r1"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    stamp = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert set(one(F.map_keys(nested.add_push(pushes, F.lit("r2"), stamp)))) == {"r1", "r2"}
    assert one(F.size(nested.add_push(pushes, F.lit("r1"), stamp))) == 1
    assert one(nested.drop_push(pushes, F.lit("r1"))) == {}
    assert one(F.size(nested.drop_push(F.lit(None).cast(nested.PUSH_MAP), F.lit("r1")))) == 0
    product = F.struct(F.lit("t").alias("title"), F.array(F.lit(1.0)).alias("embedding"))
    assert one(nested.without_embedding(product)).asDict() == {"title": "t"}


@pytest.mark.parametrize(
    "active, pushed, approved, wanted",
    [
        (1, False, 0, "Push in Progress"),
        (0, True, 0, "Push Complete"),
        (0, False, 2, "Ready to Push"),
        (0, False, 0, "Needs Review"),
    ],
)
def test_video_status(one, active, pushed, approved, wanted):
    assert one(status.video_status(F.lit(active), F.lit(pushed), F.lit(approved))) == wanted


@pytest.mark.parametrize(
    "success, total, error, wanted, pushed",
    [
        (0, 0, "boom", "FAILED", False),
        (5, 5, None, "SUCCESS", True),
        (3, 5, None, "PARTIAL_SUCCESS", True),
        (0, 5, None, "FAILED", False),
        (0, 0, None, "SUCCESS", False),
    ],
)
def test_request_status(one, success, total, error, wanted, pushed):
    args = F.lit(success), F.lit(total), F.lit(error).cast("string")
    assert one(status.request_status(*args)) == wanted
    assert one(status.counts_as_push(*args)) is pushed


@pytest.mark.parametrize(
    "old, new, exists, wanted",
    [
        (None, "APPROVED", False, (1, 1)),
        (None, "UNREVIEWED", False, (0, 1)),
        (None, "DISAPPROVED", False, (0, 1)),
        ("APPROVED", "DISAPPROVED", True, (-1, 0)),
        ("APPROVED", "APPROVED", True, (0, 0)),
        ("DISAPPROVED", "APPROVED", True, (1, 0)),
        (None, "APPROVED", True, (1, 0)),
        (None, "UNREVIEWED", True, (0, 0)),
    ],
)
def test_delta_rule(one, old, new, exists, wanted):
    got = one(status.delta_rule(F.lit(old).cast("string"), F.lit(new), F.lit(exists)))
    assert tuple(got) == wanted
