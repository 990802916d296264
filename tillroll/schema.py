"""Declared columns, keys and rules of the nine tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
POINT = T.DecimalType(9, 6)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableRules:
    schema: T.StructType
    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    between: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def not_null(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


def _table(*columns: tuple, **rules) -> TableRules:
    """Columns are (name, type, required) or, for bounded text, (name, length, required)."""
    fields, lengths = [], {}
    for name, kind, required in columns:
        if isinstance(kind, int):
            lengths[name] = kind
            kind = T.StringType()
        fields.append(T.StructField(name, kind, not required))
    return TableRules(T.StructType(fields), max_length=lengths, **rules)


_TEXT, _INT, _SHORT, _TIME = (
    T.StringType(),
    T.IntegerType(),
    T.ShortType(),
    T.TimestampNTZType(),
)

# Parents come before the tables that refer to them.
TABLES: dict[str, TableRules] = {
    "customers": _table(
        ("customer_id", 32, True),
        ("customer_unique_id", 32, True),
        ("customer_zip_code_prefix", 5, True),
        ("customer_city", 50, True),
        ("customer_state", 2, True),
        primary_key=("customer_id",),
    ),
    "sellers": _table(
        ("seller_id", 32, True),
        ("seller_zip_code_prefix", 5, True),
        ("seller_city", 50, True),
        ("seller_state", 2, True),
        primary_key=("seller_id",),
    ),
    "category_translation": _table(
        ("product_category_name", 60, True),
        ("product_category_name_english", 60, True),
        primary_key=("product_category_name",),
    ),
    "products": _table(
        ("product_id", 32, True),
        ("product_category_name", 60, False),
        ("product_name_length", _INT, False),
        ("product_description_length", _INT, False),
        ("product_photos_qty", _INT, False),
        ("product_weight_g", _INT, False),
        ("product_length_cm", _INT, False),
        ("product_height_cm", _INT, False),
        ("product_width_cm", _INT, False),
        primary_key=("product_id",),
    ),
    "geolocation": _table(
        ("zip_code_prefix", 5, True),
        ("lat", POINT, True),
        ("lng", POINT, True),
        ("city", 50, False),
        ("state", 2, False),
        primary_key=("zip_code_prefix",),
    ),
    "orders": _table(
        ("order_id", 32, True),
        ("customer_id", 32, True),
        ("order_status", 12, True),
        ("order_purchase_timestamp", _TIME, True),
        ("order_approved_at", _TIME, False),
        ("order_delivered_carrier_date", _TIME, False),
        ("order_delivered_customer_date", _TIME, False),
        ("order_estimated_delivery_date", _TIME, True),
        primary_key=("order_id",),
        unique=(("customer_id",),),
        foreign_keys=(ForeignKey("customer_id", "customers", "customer_id"),),
    ),
    "order_items": _table(
        ("order_id", 32, True),
        ("order_item_id", _SHORT, True),
        ("product_id", 32, True),
        ("seller_id", 32, True),
        ("shipping_limit_date", _TIME, True),
        ("price", MONEY, True),
        ("freight_value", MONEY, True),
        primary_key=("order_id", "order_item_id"),
        foreign_keys=(
            ForeignKey("order_id", "orders", "order_id"),
            ForeignKey("product_id", "products", "product_id"),
            ForeignKey("seller_id", "sellers", "seller_id"),
        ),
    ),
    "order_payments": _table(
        ("order_id", 32, True),
        ("payment_sequential", _SHORT, True),
        ("payment_type", 20, True),
        ("payment_installments", _SHORT, True),
        ("payment_value", MONEY, True),
        primary_key=("order_id", "payment_sequential"),
        foreign_keys=(ForeignKey("order_id", "orders", "order_id"),),
    ),
    "order_reviews": _table(
        ("review_id", 32, True),
        ("order_id", 32, True),
        ("review_score", _SHORT, True),
        ("review_comment_title", _TEXT, False),
        ("review_comment_message", _TEXT, False),
        ("review_creation_date", _TIME, True),
        ("review_answer_timestamp", _TIME, True),
        primary_key=("review_id", "order_id"),
        foreign_keys=(ForeignKey("order_id", "orders", "order_id"),),
        between={"review_score": (1, 5)},
    ),
}
