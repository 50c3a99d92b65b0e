"""Schema contracts: columns, types, NOT NULL, keys, domains and partitioning as data.

Spark's Parquet tables and its CSV reader both drop NOT NULL, so a contract is
enforced by the gate (``operators.gate``), not by DDL. Every contract can render
the Spark schema used to read files, the column list used in ``CREATE TABLE``,
and the predicates used by the quality checks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    name: str
    dtype: str  # Spark SQL type text, e.g. "DECIMAL(12,2)"
    nullable: bool = True
    comment: str = ""
    data_type: T.DataType | None = None  # set for contracts derived from a schema

    def spark_type(self) -> T.DataType:
        return self.data_type if self.data_type is not None else spark_type(self.dtype)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    ref_table: str
    ref_column: str


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    comment: str = ""

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def not_null(self) -> list[str]:
        return [c.name for c in self.columns if not c.nullable]

    def schema(self, all_nullable: bool = True) -> T.StructType:
        """Reader schema. Nullable by default: NOT NULL is the gate's job, and a
        reader given NOT NULL fields reports them nullable anyway."""
        fields = []
        for c in self.columns:
            dtype = c.spark_type()
            meta = {"comment": c.comment} if c.comment else {}
            fields.append(T.StructField(c.name, dtype, all_nullable or c.nullable, meta))
        return T.StructType(fields)

    def ddl_columns(self) -> str:
        """Column list for ``CREATE TABLE``. NOT NULL is written for the record;
        Parquet tables do not keep it."""
        parts = []
        for c in self.columns:
            text = f"`{c.name}` {c.dtype}"
            if not c.nullable:
                text += " NOT NULL"
            if c.comment:
                text += " COMMENT '" + c.comment.replace("'", "\\'") + "'"
            parts.append(text)
        return ", ".join(parts)


_SIMPLE_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "BINARY": T.BinaryType(),
}


def spark_type(text: str) -> T.DataType:
    """Spark type for a contract type name (scalar types and DECIMAL(p,s))."""
    name = text.strip().upper()
    if name.startswith("DECIMAL"):
        precision, scale = (int(x) for x in name[name.index("(") + 1 : name.index(")")].split(","))
        return T.DecimalType(precision, scale)
    return _SIMPLE_TYPES[name]


def _cols(*specs: tuple) -> tuple[Column, ...]:
    return tuple(Column(*spec) for spec in specs)


# ---------------------------------------------------------------------------
# The five compliance-audit tables, column names, types and NOT
# NULL flags exactly as the reference declares them (True = nullable).
# The keys and foreign keys of these five are ours: the reference declares none
# (its id columns are even nullable); they follow the shared column names.
# ---------------------------------------------------------------------------
CUSTOMERS = Contract(
    "customers",
    _cols(
        ("customer_id", "STRING", True),
        ("registration_country", "STRING", False),
        ("kyc_tier", "STRING", False),
        ("risk_level", "STRING", False),
        ("registration_date", "DATE", False),
        ("created_at", "TIMESTAMP", True),
    ),
    key=("customer_id",),
)

TRANSACTIONS = Contract(
    "transactions",
    _cols(
        ("tx_id", "STRING", True),
        ("customer_id", "STRING", False),
        ("corridor", "STRING", False),
        ("send_country", "STRING", False),
        ("receive_country", "STRING", False),
        ("send_amount", "DECIMAL(12,2)", False),
        ("send_currency", "STRING", False),
        ("receive_amount", "DECIMAL(12,2)", False),
        ("receive_currency", "STRING", False),
        ("disclosed_fee", "DECIMAL(8,2)", False),
        ("charged_fee", "DECIMAL(8,2)", False),
        ("disclosed_fx_rate", "DECIMAL(12,6)", False),
        ("applied_fx_rate", "DECIMAL(12,6)", False),
        ("transfer_method", "STRING", False),
        ("promised_delivery_ts", "TIMESTAMP", False),
        ("actual_delivery_ts", "TIMESTAMP", True),
        ("status", "STRING", False),
        ("created_at", "TIMESTAMP", False),
    ),
    key=("tx_id",),
    foreign_keys=(ForeignKey("customer_id", "customers", "customer_id"),),
)

DISCLOSURES = Contract(
    "disclosures",
    _cols(
        ("disclosure_id", "STRING", True),
        ("tx_id", "STRING", False),
        ("disclosed_at", "TIMESTAMP", False),
        ("disclosed_fee", "DECIMAL(8,2)", False),
        ("disclosed_fx_rate", "DECIMAL(12,6)", False),
        ("disclosed_receive_amount", "DECIMAL(12,2)", False),
        ("disclosed_delivery_window", "STRING", False),
        ("receipt_sent_at", "TIMESTAMP", True),
        ("cancellation_deadline", "TIMESTAMP", False),
        ("created_at", "TIMESTAMP", True),
    ),
    key=("disclosure_id",),
    foreign_keys=(ForeignKey("tx_id", "transactions", "tx_id"),),
)

VIOLATIONS = Contract(
    "violations",
    _cols(
        ("violation_id", "STRING", True),
        ("tx_id", "STRING", False),
        ("rule_id", "STRING", False),
        ("severity", "STRING", False),
        ("disclosed_value", "STRING", False),
        ("actual_value", "STRING", False),
        ("delta", "DECIMAL(12,6)", True),
        ("delta_pct", "DECIMAL(8,4)", True),
        ("description", "STRING", False),
        ("detected_at", "TIMESTAMP", True),
    ),
    key=("violation_id",),
    foreign_keys=(ForeignKey("tx_id", "transactions", "tx_id"),),
)

AUDIT_EVENTS = Contract(
    "audit_events",
    _cols(
        ("event_id", "STRING", True),
        ("tx_id", "STRING", False),
        ("event_type", "STRING", False),
        ("actor", "STRING", False),
        ("wall_clock_ts", "TIMESTAMP", False),
        ("sequence_num", "INT", False),
        ("payload", "STRING", False),
        ("created_at", "TIMESTAMP", True),
    ),
    key=("event_id",),
    foreign_keys=(ForeignKey("tx_id", "transactions", "tx_id"),),
)

# Load order of the audit tables in the reference's migration.
AUDIT_TABLES = (CUSTOMERS, TRANSACTIONS, DISCLOSURES, VIOLATIONS, AUDIT_EVENTS)

# ---------------------------------------------------------------------------
# The two medallion tables the reference describes column by
# column, with their declared key, status/channel domains and partitioning.
# ---------------------------------------------------------------------------
SILVER_ORDERS = Contract(
    "orders",
    _cols(
        ("order_id", "BIGINT", False, "PK"),
        ("user_id", "BIGINT", False, "FK to users"),
        ("product_id", "BIGINT", False),
        ("order_date", "DATE", False),
        ("status", "STRING", False, "pending|shipped|delivered|cancelled"),
        ("amount", "DOUBLE", True, "USD"),
        ("updated_at", "TIMESTAMP", False),
    ),
    key=("order_id",),
    foreign_keys=(ForeignKey("user_id", "users", "user_id"),),
    domains={"status": ("pending", "shipped", "delivered", "cancelled")},
    partition_by=("order_date",),
    comment="Cleansed orders with status and totals",
)

GOLD_DAILY_REVENUE = Contract(
    "daily_revenue",
    _cols(
        ("revenue_date", "DATE", False),
        ("channel", "STRING", False, "web|mobile|api"),
        ("gross_revenue", "DOUBLE", False),
        ("net_revenue", "DOUBLE", False),
        ("order_count", "BIGINT", False),
    ),
    key=("revenue_date", "channel"),
    domains={"channel": ("web", "mobile", "api")},
    partition_by=("revenue_date",),
    comment="Daily rolled-up revenue by channel",
)

# CSV dialect of the reference's typed load.
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
CSV_NULL_VALUE = ""


def contract_from_schema(name: str, schema: T.StructType, **kwargs) -> Contract:
    """Build a contract from an observed schema (the inferred path)."""
    cols = tuple(
        Column(f.name, f.dataType.simpleString().upper(), f.nullable, data_type=f.dataType)
        for f in schema.fields
    )
    return Contract(name, cols, **kwargs)


def conform(df, contract: Contract):
    """The contract's columns, in its order and types (a plain ``cast``, so a
    value that cannot be represented fails the job instead of turning NULL).
    Missing columns raise."""
    from pyspark.sql import functions as F

    missing = [c.name for c in contract.columns if c.name not in df.columns]
    if missing:
        raise ValueError(f"{contract.name}: missing columns {missing}")
    return df.select(*[F.col(c.name).cast(c.spark_type()).alias(c.name) for c in contract.columns])
