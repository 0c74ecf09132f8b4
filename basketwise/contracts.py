"""What a valid customers, products or orders table looks like."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnRule:
    name: str
    kind: str  # "string", "int", "float" or "date"; "int" accepts fractions
    minimum: int | None = None
    allowed: tuple[str, ...] = ()
    required: bool = True

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")


@dataclass(frozen=True)
class Contract:
    name: str
    key: str
    rules: tuple[ColumnRule, ...]
    parents: dict[str, str] = field(default_factory=dict)  # foreign key column -> dataset

    @property
    def columns(self) -> list[str]:
        return [rule.name for rule in self.rules]

    @property
    def required(self) -> list[str]:
        return [rule.name for rule in self.rules if rule.required]


# The columns of the three datasets and what is allowed in them.
CONTRACTS: dict[str, Contract] = {
    c.name: c
    for c in (
        Contract(
            "customers",
            "customer_id",
            (
                ColumnRule("customer_id", "string"),
                ColumnRule("signup_date", "date"),
                ColumnRule("city", "string"),
                ColumnRule("age_group", "string"),
                ColumnRule("acquisition_channel", "string"),
            ),
        ),
        Contract(
            "products",
            "product_id",
            (
                ColumnRule("product_id", "string"),
                ColumnRule("product_name", "string"),
                ColumnRule("category", "string"),
                ColumnRule("sub_category", "string"),
                ColumnRule("cost_price", "float", minimum=0),
                ColumnRule("selling_price", "float", minimum=0),
                ColumnRule("launch_date", "date"),
            ),
        ),
        Contract(
            "orders",
            "order_id",
            (
                ColumnRule("order_id", "string"),
                ColumnRule("customer_id", "string"),
                ColumnRule("product_id", "string"),
                ColumnRule("order_date", "date"),
                ColumnRule("quantity", "int", minimum=1),
                ColumnRule("unit_price", "float", minimum=0),
                ColumnRule("discount_pct", "float", minimum=0),
                ColumnRule("order_status", "string", allowed=("Completed", "Cancelled", "Returned")),
            ),
            parents={"customer_id": "customers", "product_id": "products"},
        ),
    )
}

#: Parents come before the datasets that refer to them.
LOAD_ORDER = ("customers", "products", "orders")


def contract_of(dataset: str) -> Contract:
    if dataset not in CONTRACTS:
        raise ValueError(f"unknown dataset {dataset!r}; there are {list(CONTRACTS)}")
    return CONTRACTS[dataset]
