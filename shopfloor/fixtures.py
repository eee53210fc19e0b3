"""Domain views over the given TPC-H-like tables, in Spark and in DuckDB SQL.

Each view exists twice: as a DataFrame builder for ``queries()`` and as a SQL text for
``oracle_sql()``. ``FIXTURES.md`` describes the mapping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import COMPONENT_CATALOG
from .operators.series import DAY, Series, ordinal
from .session import materialize, new_path

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"

# Weekly slices: 168 hourly rows each, so that results at test size cross slice borders.
TELEMETRY = Series(("machine_id",), ("datetime",), 7 * DAY)
EVENTS = Series(("machine_id",), ("ts", "event_id"), 7 * DAY)

# Derived tables already written, by session, folder and name.
_STORED: dict[tuple[str, str, str], DataFrame] = {}

# Schemas of the given tables; stating them saves a job per read.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,
        o_orderpriority string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

KINDS = ["robot", "laser", "press_brake", "punching"]


class Views:
    """DataFrame builders over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def ev(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            "ts",
            F.col("user_id").alias("machine_id"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    def telemetry(self) -> DataFrame:
        """Hourly telemetry, derived once per session and folder and kept as a table.

        Deriving it numbers the rows of every machine; the queries then scan a stored table,
        as they would in production.
        """
        return self.stored("telemetry", self._derive_telemetry)

    def stored(self, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, written on first use in this session and folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            _STORED[key] = materialize(derive(), name)
        return _STORED[key]

    def _derive_telemetry(self) -> DataFrame:
        source = Series(
            ("l_suppkey",),
            ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"),
            365 * DAY,
        )
        rows = self.table("lineitem").select(*source.keys, *source.order, "l_extendedprice", "l_discount", "l_tax")
        return ordinal(rows, source, "step").select(
            F.col("l_suppkey").alias("machine_id"),
            F.expr(f"timestampadd(HOUR, cast(step as int), {EPOCH})").alias("datetime"),
            F.col("l_quantity").alias("volt"),
            F.col("l_extendedprice").alias("rotate"),
            F.col("l_discount").alias("pressure"),
            F.col("l_tax").alias("vibration"),
        )

    def errors(self) -> DataFrame:
        return self.ev().filter("event_type = 'error'").select(
            "event_id", "machine_id", hour("ts").alias("datetime"),
            F.concat(F.lit("error"), (1 + F.col("k") % 5).cast("string")).alias("error_id"),
        )

    def maint(self) -> DataFrame:
        return self.ev().filter("event_type = 'purchase'").select(
            "event_id", "machine_id",
            F.when(F.col("k") % 2 == 0, hour("ts")).otherwise(F.col("ts")).alias("datetime"),
            F.concat(F.lit("comp"), (1 + F.col("k") % 4).cast("string")).alias("comp"),
        )

    def failures(self) -> DataFrame:
        return self.ev().filter("event_type = 'signup' and k % 10 = 0").select(
            "event_id", "machine_id", hour("ts").alias("datetime"),
            F.concat(F.lit("comp"), (1 + F.floor(F.col("k") / 10) % 4).cast("string")).alias("failure"),
        )

    def machines(self) -> DataFrame:
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("s_suppkey") % 4 + 1).cast("int"))
        return self.table("supplier").select(
            F.col("s_suppkey").alias("machine_id"),
            F.concat(F.lit("model"), (1 + F.col("s_nationkey") % 4).cast("string")).alias("model"),
            (F.col("s_suppkey") % 20).cast("int").alias("age"),
            kind.alias("machine_type"),
            F.col("s_name").alias("machine_code"),
            F.concat(F.lit("line "), F.col("s_nationkey").cast("string")).alias("location"),
        )

    def live_metrics(self) -> DataFrame:
        return self.ev().select(
            "event_id", "machine_id", F.least("value", F.lit(100.0)).alias("load_percentage"),
            F.col("ts").alias("updated_at"),
        )

    def scores(self) -> DataFrame:
        return self.ev().select(
            "event_id", "machine_id", "ts", F.least("value", F.lit(100.0)).alias("risk"),
            (F.col("event_type") == "error").cast("int").alias("label"),
        )

    def predictions(self) -> DataFrame:
        third = F.col("k") % 3
        return self.ev().select(
            "event_id", F.col("ts").alias("time"), "machine_id",
            F.concat(F.lit("comp"), (1 + F.col("k") % 4).cast("string")).alias("comp"),
            F.least("value", F.lit(100.0)).alias("risk_probability"),
            F.when(third == 0, True).when(third == 1, False).alias("is_verified_true"),
        )

    def tickets(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("ticket_id"),
            F.col("o_custkey").alias("machine_id"),
            F.concat(F.lit("comp"), (1 + F.col("o_orderkey") % 4).cast("string")).alias("comp"),
            F.col("o_orderdate").alias("created_at"),
            F.when(status == "F", "RESOLVED").when(status == "P", "IN_PROGRESS").otherwise("PENDING").alias("status"),
        )

    def cycles(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("cycle_id"), F.col("embedding").cast("array<double>").alias("samples"), "label"
        )

    def memory(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("memory"), "label"
        )

    def component_risks(self) -> DataFrame:
        """Latest risk per machine and component, one row each."""
        return self.predictions().groupBy("machine_id", "comp").agg(
            F.max_by("risk_probability", F.struct("time", "event_id")).alias("risk")
        )


def hour(column: str) -> Column:
    return F.date_trunc("hour", column).cast("timestamp_ntz")


_CATALOG = ",\n".join(f"('{k}', '{c}', '{n}', {d})" for k, c, n, d in COMPONENT_CATALOG)

SQL_VIEWS = {
    "ev": """SELECT event_id, ts, user_id AS machine_id, event_type, value,
        CAST(props->>'$.k' AS INT) AS k FROM events""",
    "telemetry": """SELECT l_suppkey AS machine_id,
        TIMESTAMP '2024-01-01' + (row_number() OVER (PARTITION BY l_suppkey
          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1) * INTERVAL 1 HOUR AS datetime,
        l_quantity AS volt, l_extendedprice AS rotate, l_discount AS pressure, l_tax AS vibration FROM lineitem""",
    "errors": """SELECT event_id, machine_id, date_trunc('hour', ts) AS datetime, 'error' || (1 + k % 5) AS error_id
        FROM ev WHERE event_type = 'error'""",
    "maint": """SELECT event_id, machine_id, CASE WHEN k % 2 = 0 THEN date_trunc('hour', ts) ELSE ts END AS datetime,
        'comp' || (1 + k % 4) AS comp FROM ev WHERE event_type = 'purchase'""",
    "failures": """SELECT event_id, machine_id, date_trunc('hour', ts) AS datetime, 'comp' || (1 + (k // 10) % 4) AS failure
        FROM ev WHERE event_type = 'signup' AND k % 10 = 0""",
    "machines": """SELECT s_suppkey AS machine_id, 'model' || (1 + s_nationkey % 4) AS model,
        CAST(s_suppkey % 20 AS INT) AS age,
        (['robot', 'laser', 'press_brake', 'punching'])[CAST(s_suppkey % 4 + 1 AS INT)] AS machine_type,
        s_name AS machine_code, 'line ' || s_nationkey AS location FROM supplier""",
    "catalog": f"""SELECT * FROM (VALUES {_CATALOG}) AS t(machine_type, comp_code, comp_name, baseline_lifespan_days)""",
    "live_metrics": """SELECT event_id, machine_id, least(value, 100.0) AS load_percentage, ts AS updated_at FROM ev""",
    "scores": """SELECT event_id, machine_id, ts, least(value, 100.0) AS risk,
        CAST(event_type = 'error' AS INT) AS label FROM ev""",
    "predictions": """SELECT event_id, ts AS time, machine_id, 'comp' || (1 + k % 4) AS comp,
        least(value, 100.0) AS risk_probability,
        CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_verified_true FROM ev""",
    "tickets": """SELECT o_orderkey AS ticket_id, o_custkey AS machine_id, 'comp' || (1 + o_orderkey % 4) AS comp,
        o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status FROM orders""",
    "cycles": """SELECT vec_id AS cycle_id, CAST(embedding AS DOUBLE[]) AS samples, label FROM embeddings""",
    "memory": """SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS memory, label FROM embeddings""",
    "component_risks": """SELECT machine_id, comp, arg_max(risk_probability, (time, event_id)) AS risk
        FROM predictions GROUP BY machine_id, comp""",
}

_NEEDS = {
    "errors": ["ev"], "maint": ["ev"], "failures": ["ev"], "live_metrics": ["ev"], "scores": ["ev"],
    "predictions": ["ev"], "component_risks": ["ev", "predictions"],
}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views (blank-separated) as common table expressions.

    ``body`` may start with further expressions of its own, each ended by ``;;``.
    """
    wanted: list[str] = []
    for name in names.split():
        for n in [*_NEEDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in wanted]
    *extra, final = body.split(";;")
    parts += [e.strip() for e in extra]
    return (f"WITH {', '.join(parts)} " if parts else "") + final.strip()


def feed(df: DataFrame, ts: str, bounds: Sequence[str], label: str) -> Iterator[str]:
    """A test feed: appends the rows between ``bounds`` one after the other and gives the folder after each."""
    path = new_path(df.sparkSession, label)
    kind = df.schema[ts].dataType
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(ts) >= F.lit(lo).cast(kind))
        if hi is not None:
            part = part.filter(F.col(ts) < F.lit(hi).cast(kind))
        part.write.mode("append").parquet(path)
        yield path
