"""Tables from a declared schema: generators as expressions over a row id, parents linked by keys.

A row's values depend on the seed, the column and the row id alone, so any partitioning gives the same table.
Sampled parents are joined by a drawn row number, driven children are exploded from their parents.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions.keyed import integer, key_hash, pick, uniform, weighted_pick
from quillmask.functions.ordinals import with_rank
from quillmask.operators.actions import token

#: Parts of invented names and streets.
FIRST_NAMES = ["Quill", "Wren", "Sorrel", "Linden", "Marlow", "Tamsin", "Orla", "Fennel", "Ash", "Juniper"]
LAST_NAMES = ["Inkwell", "Vellum", "Nibley", "Blotter", "Foolscap", "Parchment", "Margin"]
STREETS = ["Quarto Row", "Folio Crescent", "Octavo Walk", "Ledger Way", "Colophon Court"]
# The generators there are.
GENERATORS = "person-name email phone address integer decimal boolean category date datetime sequence uuid constant copy-column template date-after foreign-key lookup-foreign date-after-foreign".split()


@dataclass(frozen=True)
class Field:
    name: str
    generator: str
    settings: dict = field(default_factory=dict)
    null_rate: float = 0.0

    def __post_init__(self):
        if self.generator not in GENERATORS:
            raise ValueError(f"{self.name}: unknown generator {self.generator}")
        if not 0 <= self.null_rate <= 1:
            raise ValueError(f"{self.name}: null_rate is a share")

    def needs(self) -> list[str]:
        return [self.settings[k] for k in ("source", "key") if k in self.settings]


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    rows: int = 100
    primary_key: str = ""

    def parents(self) -> set[str]:
        return {f.settings["table"] for f in self.fields if f.generator == "foreign-key"}

    def driver(self) -> Field | None:
        drivers = [f for f in self.fields if f.generator == "foreign-key" and f.settings.get("mode") == "DRIVER"]
        if len(drivers) > 1:
            raise ValueError(f"{self.name}: more than one DRIVER key")
        return drivers[0] if drivers else None


def in_order(nodes: dict[str, set[str]], what: str) -> list[str]:
    """Names with their needs first; a cycle is an error."""
    try:
        return list(TopologicalSorter(nodes).static_order())
    except CycleError as e:
        raise ValueError(f"{what} depend on each other: {' -> '.join(e.args[1])}") from None


def validate(tables: list[Table]) -> None:
    by_name = {t.name: t for t in tables}
    if len(by_name) != len(tables):
        raise ValueError("two tables have one name")
    for t in tables:
        names = [f.name for f in t.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"{t.name}: two columns have one name")
        if t.primary_key and (t.primary_key not in names or next(f for f in t.fields if f.name == t.primary_key).null_rate):
            raise ValueError(f"{t.name}: the primary key must be a column without nulls")
        for f in t.fields:
            for need in f.needs():
                if need not in names:
                    raise ValueError(f"{t.name}.{f.name}: no column {need}")
            if f.generator == "foreign-key":
                parent = by_name.get(f.settings["table"])
                if parent is None or parent.name == t.name or not parent.primary_key:
                    raise ValueError(f"{t.name}.{f.name}: a foreign key needs another table with a primary key")
        t.driver()
    in_order({t.name: t.parents() for t in tables}, "tables")


def value(f: Field, row: Column, seed: int, scope: str) -> Column:
    """The expression of a generator that needs no other table."""
    s, key = f.settings, f"{scope}.{f.name}"
    draw = lambda lo, hi, tag="": integer(seed, f"{key}{tag}", lo, hi, row)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    if f.generator == "person-name":
        return F.concat_ws(" ", pick(seed, f"{key}:f", FIRST_NAMES, row), pick(seed, f"{key}:l", LAST_NAMES, row))
    if f.generator == "email":
        return F.concat(F.lit("test_"), token(seed, key, 10, row), F.lit("@example.invalid"))
    if f.generator == "phone":
        return F.concat(F.lit("04"), pad(draw(0, 99, "a"), 2), F.lit(" "), pad(draw(0, 999, "b"), 3), F.lit(" "), pad(draw(0, 999, "c"), 3))
    if f.generator == "address":
        return F.concat(draw(1, 999).cast("string"), F.lit(" "), pick(seed, f"{key}:s", STREETS, row), F.lit(", Inkborough"))
    if f.generator == "integer":
        return draw(*sorted((s.get("minimum", 1), s.get("maximum", 1000)))).cast("string")
    if f.generator == "decimal":
        low, high = s.get("minimum", 0), s.get("maximum", 1000)
        return F.format_string(f"%.{s.get('decimals', 2)}f", F.lit(float(low)) + uniform(seed, key, row) * float(high - low))
    if f.generator == "boolean":
        return pick(seed, key, ["true", "false"], row)
    if f.generator == "category":
        values = s.get("values", [])
        return weighted_pick(seed, key, list(zip(values, s.get("weights") or [1] * len(values), strict=True)), row) if values else F.lit("")
    if f.generator in ("date", "datetime"):
        first, last = F.to_date(F.lit(s.get("start", "2020-01-01"))), F.to_date(F.lit(s.get("end", "2035-12-31")))
        day = F.date_add(first, integer(seed, key, F.lit(0), F.datediff(last, first), row).cast("int")).cast("string")
        return day if f.generator == "date" else F.concat(day, F.lit(" "), pad(draw(0, 23, "h"), 2), F.lit(":"), pad(draw(0, 59, "m"), 2), F.lit(":00"))
    if f.generator == "sequence":
        number = (F.lit(s.get("start", 1)) + row * F.lit(s.get("step", 1) or 1)).cast("string")
        return F.concat(F.lit(s.get("prefix", "ID-")), F.lpad(number, F.greatest(F.lit(s.get("width", 5)), F.length(number)), F.lit("0")))
    if f.generator == "uuid":
        h = F.concat(*[F.lpad(F.lower(F.hex(key_hash(seed, f"{key}:{i}", row))), 16, "0") for i in (1, 2)])
        part = lambda at, n: F.substring(h, at, n)
        return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(pick(seed, key, list("89ab"), row), part(18, 3)), part(21, 12))
    if f.generator == "constant":
        return F.lit(str(s.get("value", "Test")))
    source = F.col(s["source"])
    if f.generator == "copy-column":
        return source
    if f.generator == "template":
        return F.concat(F.lit(s.get("prefix", "")), source, F.lit(s.get("suffix", "")))
    return days_after(source, s, row, seed, key)


def days_after(source: Column, s: dict, row: Column, seed: int, key: str) -> Column:
    low, high = sorted((s.get("minimum_days", 1), s.get("maximum_days", 30)))
    return F.coalesce(F.date_add(F.to_date(F.try_to_timestamp(source)), integer(seed, key, low, high, row).cast("int")).cast("string"), F.lit(""))


def with_nulls(df: DataFrame, f: Field, seed: int, scope: str, rows: int) -> DataFrame:
    """Exactly round(rows * rate) blanks, at the rows of least keyed hash."""
    k = round(rows * f.null_rate)
    if not k:
        return df
    ranked = with_rank(df.withColumn("g_u", uniform(seed, f"{scope}.{f.name}:null", F.col("g_row"))), "g_u", ["g_row"], "g_rank")
    return ranked.withColumn(f.name, F.when(F.col("g_rank") <= k, "").otherwise(F.col(f.name))).drop("g_u", "g_rank")


def generated(spark: SparkSession, tables: list[Table], seed: int = 1) -> dict[str, DataFrame]:
    """All tables, parents first. Each has its columns and g_row, a 0-based row number."""
    validate(tables)
    by_name, made = {t.name: t for t in tables}, {}
    counts: dict[str, int] = {}
    for name in in_order({t.name: t.parents() for t in tables}, "tables"):
        t, driver = by_name[name], by_name[name].driver()
        if driver:
            parent = by_name[driver.settings["table"]]
            low, high = driver.settings.get("minimum", 0), driver.settings.get("maximum", 5)
            kids = made[parent.name].select(F.col(parent.primary_key).alias(driver.name), F.col("g_row").alias("g_parent"), integer(seed, f"{name}:children", low, high, F.col("g_row")).alias("g_kids"))
            if kids.where("g_kids > 0").isEmpty():  # a table without rows: one parent, drawn by the seed, gets a child
                lucky = F.col("g_parent") == integer(seed, f"{name}:lucky", 0, max(0, counts[parent.name] - 1), F.lit(0))
                kids = kids.withColumn("g_kids", lucky.cast("long"))
            df = kids.where("g_kids > 0").withColumn("g_kid", F.explode(F.sequence(F.lit(1).cast("long"), F.col("g_kids"))))
            order = F.col("g_parent") * F.lit(max(1, high)) + F.col("g_kid") - 1
            df = with_rank(df.withColumn("g_order", order), "g_order", ["g_parent"], "g_row")
            df = df.withColumn("g_row", F.col("g_row") - 1).drop("g_parent", "g_kids", "g_kid", "g_order")
        else:
            df = spark.range(t.rows).withColumnRenamed("id", "g_row")
        for f in (x for x in t.fields if x.generator == "foreign-key" and x is not driver):
            parent = by_name[f.settings["table"]]
            n = counts[parent.name]
            spot = F.pmod(F.col("g_row"), F.lit(n)) if f.settings.get("mode") == "ROW_ALIGNED" else integer(seed, f"{name}.{f.name}", 0, n - 1, F.col("g_row"))
            keys = made[parent.name].select(F.col("g_row").alias("g_spot"), F.col(parent.primary_key).alias(f.name))
            df = df.withColumn("g_spot", spot).join(keys, "g_spot").drop("g_spot")
        order = in_order({f.name: set(f.needs()) for f in t.fields}, "columns")
        fields = {f.name: f for f in t.fields}
        for f in (fields[x] for x in order):
            if f.generator in ("lookup-foreign", "date-after-foreign"):
                parent = by_name[fields[f.settings["key"]].settings["table"]]
                looked = made[parent.name].select(F.col(parent.primary_key).alias("g_key"), F.col(f.settings["column"]).alias("g_value"))
                df = df.join(looked, F.col(f.settings["key"]) == F.col("g_key"), "left")
                out = F.coalesce("g_value", F.lit("")) if f.generator == "lookup-foreign" else days_after(F.col("g_value"), f.settings, F.col("g_row"), seed, f"{name}.{f.name}")
                df = df.withColumn(f.name, out).drop("g_key", "g_value")
            elif f.generator != "foreign-key":
                df = df.withColumn(f.name, value(f, F.col("g_row"), seed, name))
        counts[name] = df.count() if driver else t.rows
        for f in t.fields:
            df = with_nulls(df, f, seed, name, counts[name])
        made[name] = df.select("g_row", *[f.name for f in t.fields])
    return made


def connected_scenario(people: int = 200, products: int = 50) -> list[Table]:
    """People, products, orders and appointments with valid keys, child counts, copied attributes and linked dates."""
    return [
        Table("people", (Field("person_id", "sequence", {"prefix": "PER-", "width": 6}), Field("full_name", "person-name"), Field("email", "email"), Field("joined_date", "date", {"start": "2024-01-01", "end": "2025-12-31"}), Field("customer_segment", "category", {"values": ["Standard", "Plus", "Business"], "weights": [65, 25, 10]})), people, "person_id"),
        Table("products", (Field("product_id", "sequence", {"prefix": "PRD-"}), Field("product_name", "template", {"source": "product_id", "prefix": "Product "}), Field("category", "category", {"values": ["Home", "Office", "Outdoor", "Technology"], "weights": [30, 25, 20, 25]}), Field("price", "decimal", {"minimum": 5, "maximum": 999})), products, "product_id"),
        Table("orders", (
            Field("order_id", "sequence", {"prefix": "ORD-", "width": 7}), Field("person_id", "foreign-key", {"table": "people", "mode": "DRIVER", "minimum": 0, "maximum": 5}), Field("product_id", "foreign-key", {"table": "products"}),
            Field("customer_segment", "lookup-foreign", {"key": "person_id", "column": "customer_segment"}), Field("order_date", "date-after-foreign", {"key": "person_id", "column": "joined_date", "minimum_days": 0, "maximum_days": 365}),
            Field("status", "category", {"values": ["Pending", "Paid", "Shipped", "Cancelled"], "weights": [20, 45, 30, 5]}), Field("quantity", "integer", {"minimum": 1, "maximum": 8}), Field("unit_price", "lookup-foreign", {"key": "product_id", "column": "price"}),
        ), primary_key="order_id"),
        Table("appointments", (
            Field("appointment_id", "sequence", {"prefix": "APT-", "width": 6}), Field("person_id", "foreign-key", {"table": "people", "mode": "DRIVER", "minimum": 0, "maximum": 3}),
            Field("appointment_date", "date-after-foreign", {"key": "person_id", "column": "joined_date", "minimum_days": 1, "maximum_days": 730}), Field("follow_up_date", "date-after", {"source": "appointment_date", "minimum_days": 7, "maximum_days": 30}),
            Field("status", "category", {"values": ["Booked", "Completed", "Cancelled"], "weights": [45, 45, 10]}),
        ), primary_key="appointment_id"),
    ]


#: Single-table templates by id.
TEMPLATES: dict[str, tuple[Field, ...]] = {"blank": ()} | {t.name: tuple(f for f in t.fields if "foreign" not in f.generator and f.settings.get("source", "") in ("", *[g.name for g in t.fields if "foreign" not in g.generator])) for t in connected_scenario()}


def from_template(name: str, rows: int, taken: list[str] = ()) -> Table:
    """A table of a template's columns, under the template's name or, where that is taken (whatever its case), with a number."""
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name}; there are {', '.join(TEMPLATES)}")
    used, free, k = {t.lower() for t in taken}, name, 2
    while free.lower() in used:
        free, k = f"{name}_{k}", k + 1
    return Table(free, TEMPLATES[name], rows)
