from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from tests.shop import rows
from tillroll import load
from tillroll.schema import TABLES
from tillroll.scope import MONTH_COLUMN
from tillroll.sources import manifest, raw_csv, store

RAW = {
    "customers": (
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        '"c1","p1","01001","sao paulo","SP"\n"c2","p1",09790,"embu, das artes",SP\n'
    ),
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01001,santo andre,SP\n",
    "category_translation": (
        "﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n"
    ),
    "products": (
        "product_id,product_category_name,product_name_lenght,product_description_lenght,"
        "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
        "x1,beleza_saude,40.0,287,1,225,16.0,10,14\nx2,,,,,,,,\n"
    ),
    "geolocation": (
        "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
        "01001,-23.5,-46.5,sao paulo,SP\n01001,-23.6,-46.6,são paulo,SP\n"
        "01001,-23.7,-46.7,sao paulo,RJ\n"
        "09790,1.0000004,2,b,SP\n09790,1.0000016,2,a,SP\n"
    ),
    "orders": (
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,,2017-10-10 21:25:13,2017-10-18 00:00:00\n"
        "o2,c2,canceled,2017-10-03 00:00:00,,,,2017-10-20 00:00:00\n"
    ),
    "order_items": (
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o1,1,x1,s1,2017-10-06 11:07:15,29.99,8.72\n"
    ),
    "order_payments": (
        "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
        "o1,1,credit_card,1,18.12\no1,2,voucher,1,2.00\n"
    ),
    "order_reviews": (
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,4,"NA","line one\nline ""two"", done",2017-10-11 00:00:00,2017-10-12 03:43:48\n'
        "r2,o2,1,,,2017-10-11 00:00:00,2017-10-12 03:43:48\n"
    ),
}


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for table, text in RAW.items():
        (folder / raw_csv.RAW_FILES[table]).write_text(text, encoding="utf-8")
    return folder


def test_whole_load(spark, raw, tmp_path):
    target = str(tmp_path / "tables")
    tables = store.load_tables(spark, str(raw), target)

    for name, df in tables.items():
        assert [(f.name, f.dataType) for f in df.schema if f.name != MONTH_COLUMN] == [
            (f.name, f.dataType) for f in TABLES[name].schema
        ]
    assert {r.customer_zip_code_prefix for r in tables.customers.collect()} == {"01001", "09790"}
    assert rows(tables.category_translation) == [("beleza_saude", "health_beauty")]
    assert sorted(rows(tables.products)) == [
        ("x1", "beleza_saude", 40, 287, 1, 225, 16, 10, 14), ("x2",) + (None,) * 8]
    assert sorted(rows(tables.geolocation)) == [
        ("01001", Decimal("-23.600000"), Decimal("-46.600000"), "sao paulo", "SP"),
        ("09790", Decimal("1.000001"), Decimal("2.000000"), "a", "SP"),
    ]
    first = tables.orders.filter("order_id = 'o1'").first()
    assert first.order_purchase_timestamp == datetime(2017, 10, 2, 10, 56, 33)
    assert first.order_delivered_carrier_date is None
    assert rows(tables.order_items)[0][5:] == (Decimal("29.99"), Decimal("8.72"))
    review = tables.order_reviews.filter("review_id = 'r1'").first()
    assert review.review_comment_title is None
    assert review.review_comment_message == 'line one\nline "two", done'

    report = rows(store.reconcile_load(spark, str(raw), target))
    assert {r[3] for r in report} == {"OK"}
    assert dict((r[0], r[1]) for r in report)["geolocation"] == 2

    # a second load replaces the first
    store.load_tables(spark, str(raw), target)
    assert store.RetailTables.read(spark, target).order_payments.count() == 2


def test_reconcile_finds_differences(spark):
    one, two = spark.range(1), spark.range(2)
    got = rows(store.reconcile({"a": one, "b": one, "c": one}, {"a": one, "b": two, "d": two}))
    assert got == [("a", 1, 1, "OK"), ("b", 1, 2, "MISMATCH"), ("c", 1, None, "MISMATCH"),
                   ("d", None, 2, "MISMATCH")]


def test_every_null_token(spark):
    df = spark.createDataFrame([(t,) for t in raw_csv.NULL_TOKENS + ["none", " ", "0"]], "t string")
    kept = [r[0] for r in rows(raw_csv.nulls_from_tokens(df)) if r[0] is not None]
    assert kept == ["none", " ", "0"]


@pytest.mark.parametrize("bad", ["40.5", "forty"])
def test_measures_must_be_whole(spark, bad):
    text = spark.createDataFrame([("x", None, bad)], "product_id string, product_category_name string, product_name_lenght string")
    with pytest.raises(Exception, match="not a whole number|CAST_INVALID_INPUT"):
        raw_csv.clean_products(text).collect()


def test_bad_values_fail_the_load(spark):
    text = spark.createDataFrame(
        [("o1", "1", "x", "s", "2017-01-01 00:00:00", "ten", "1.00")],
        "order_id string, order_item_id string, product_id string, seller_id string,"
        "shipping_limit_date string, price string, freight_value string",
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        raw_csv.convert(text, "order_items").collect()


def test_broken_rows_fail_the_read(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        raw_csv.read_text_csv(spark, str(tmp_path / "t.csv")).collect()


def test_columns_are_matched_by_name(spark):
    text = spark.createDataFrame([("SP", "s", "city", "01001")],
                                 "seller_state string, seller_id string, seller_city string, seller_zip_code_prefix string")
    assert rows(raw_csv.convert(text, "sellers")) == [("s", "01001", "city", "SP")]


def test_load_job(spark, raw, tmp_path, capsys):
    (raw / "customers.csv").rename(raw / "people.csv")
    assert load.main([str(raw), str(tmp_path / "t"), "--file", "customers=people.csv"]) == 0
    assert "customers                            2               2  OK" in capsys.readouterr().out


def test_a_raw_table_may_be_many_files(spark, raw):
    header, first, second = RAW["customers"].splitlines()
    folder = raw / "customers"
    folder.mkdir()
    (folder / "1.csv").write_text(f"{header}\n{first}\n")
    (folder / "2.csv").write_text(f"{header}\n{second}\n")
    tables = store.raw_tables(spark, str(raw), {**raw_csv.RAW_FILES, "customers": "customers/*.csv"})
    assert tables.customers.count() == 2


def test_files_of_one_table_must_agree_in_their_header(spark, raw):
    folder = raw / "sellers"
    folder.mkdir()
    (folder / "1.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\na,01001,rio,RJ\n")
    (folder / "2.csv").write_text("seller_id,seller_zip_code_prefix,seller_state,seller_city\nb,01002,RJ,rio\n")
    for one in ("1.csv", "2.csv"):
        tables = store.raw_tables(spark, str(raw), {**raw_csv.RAW_FILES, "sellers": f"sellers/{one}"})
        assert rows(tables.sellers)[0][2:] == ("rio", "RJ")
    both = store.raw_tables(spark, str(raw), {**raw_csv.RAW_FILES, "sellers": "sellers"})
    with pytest.raises(Exception, match="(?i)header"):
        both.sellers.collect()


def test_most_frequent_names_and_ties(spark):
    points = [("1", "1.0", "2.0", c, s) for c, s in
              [("b", "X"), ("b", "Y"), ("a", "Y"), ("a", "Z"), (None, "Z"), (None, None)]]
    points += [("2", None, "3.0", None, None), (None, "9.0", "9.0", "q", "Q")]
    names = [f"geolocation_{c} string" for c in ("zip_code_prefix", "lat", "lng", "city", "state")]
    got = sorted(rows(raw_csv.rollup_geolocation(spark.createDataFrame(points, ", ".join(names)))))
    assert got == [("1", Decimal("1"), Decimal("2"), "a", "Y"), ("2", None, Decimal("3"), None, None)]


def _status(report):
    return {r[0]: r[3] for r in rows(report)}


def test_a_swapped_value_and_a_lost_row_are_mismatches(spark, raw, tmp_path):
    target = str(tmp_path / "tables")
    stored = store.load_tables(spark, str(raw), target)
    payments, customers = RAW["order_payments"].splitlines(), RAW["customers"].splitlines()
    swapped = [payments[0], *(a.replace("18.12", "x").replace("2.00", "18.12").replace("x", "2.00") for a in payments[1:])]
    (raw / "order_payments.csv").write_text("\n".join(swapped) + "\n")
    (raw / "customers.csv").write_text("\n".join(customers[:-1]) + "\n")
    got = _status(store.reconcile_load(spark, str(raw), target))
    assert {t for t, s in got.items() if s == "MISMATCH"} == {"order_payments", "customers"}
    # the order of rows does not matter
    (raw / "order_payments.csv").write_text("\n".join([payments[0], *payments[:0:-1]]) + "\n")
    assert _status(store.reconcile_load(spark, str(raw), target))["order_payments"] == "OK"
    assert stored.order_payments.count() == 2


def test_a_failed_load_leaves_the_old_tables(spark, raw, tmp_path, monkeypatch):
    target = str(tmp_path / "tables")
    store.load_tables(spark, str(raw), target)
    before = {name: sorted(map(repr, df.collect())) for name, df in store.RetailTables.read(spark, target).items()}
    (raw / "sellers.csv").write_text(RAW["sellers"] + "s2,01001,rio,RJ\n")
    (raw / "order_items.csv").write_text(RAW["order_items"].replace("29.99", "ten"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        store.load_tables(spark, str(raw), target)
    after = {name: sorted(map(repr, df.collect())) for name, df in store.RetailTables.read(spark, target).items()}
    assert after == before
    # what the failed load has written goes on request, the published version stays
    assert len(manifest.remove_unpublished(spark, target)) == 1
    assert store.RetailTables.read(spark, target).sellers.count() == 1

    (raw / "order_items.csv").write_text(RAW["order_items"])
    tables = store.load_tables(spark, str(raw), target)
    assert tables.sellers.count() == 2
    assert store.RetailTables.read(spark, str(tmp_path / "nothing")).items is not None
    with pytest.raises(FileNotFoundError, match="no table orders"):
        store.RetailTables.read(spark, str(tmp_path / "nothing")).orders


def test_one_table_is_replaced_alone(spark, raw, tmp_path):
    target = str(tmp_path / "tables")
    store.load_tables(spark, str(raw), target)
    (raw / "sellers.csv").write_text(RAW["sellers"] + "s2,01001,rio,RJ\n")
    tables = store.store_tables(spark, store.raw_tables(spark, str(raw)), target, only=["sellers"])
    assert (tables.sellers.count(), tables.orders.count()) == (2, 2)
    assert store.RetailTables.read(spark, target).order_items.count() == 1
