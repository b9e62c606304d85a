"""Run tables derived from the driver's tables.

The SQL below is plain enough for Spark and DuckDB alike: ``{name}`` stands for
a table, doubles carry an exponent, and ``side`` is renamed to ``set`` in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

S4 = ["s1", "s2", "s3", "s4"]
S7 = [*S4, "s1_dup", "s2_near", "s_const"]

_KEYED = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
       CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS run_id,
       l_linestatus AS op,
       CASE WHEN l_returnflag = 'N' THEN 'nominal' ELSE 'failure' END AS side,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS class,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE 1e0 + CAST(
         (l_partkey * 7 + l_suppkey * 13 + l_linenumber * 101) % 997 AS DOUBLE) / 997e0 * 59e0
       END AS intensity,
       l_partkey, l_suppkey, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t
FROM {lineitem}
"""

# operating points F and O; faults A and R move some sensors with intensity;
# s1_dup, s2_near and s_const are planted redundancy
RUNS = f"""
SELECT run_id, op, side, class, intensity,
       q + CASE WHEN class = 'A' THEN 1.44e0 * intensity
                WHEN class = 'R' THEN 0.36e0 * intensity ELSE 0e0 END AS s1,
       e - CASE WHEN class = 'A' THEN 1500e0 * intensity ELSE 0e0 END AS s2,
       d * 100e0 AS s3,
       t * 100e0 + 1e-1 * d * 100e0
         + CASE WHEN class = 'R' THEN 1e-1 * intensity ELSE 0e0 END AS s4,
       q + CASE WHEN class = 'A' THEN 1.44e0 * intensity
                WHEN class = 'R' THEN 0.36e0 * intensity ELSE 0e0 END AS s1_dup,
       e - CASE WHEN class = 'A' THEN 1500e0 * intensity ELSE 0e0 END + 10e0 * q AS s2_near,
       42e0 AS s_const
FROM ({_KEYED}) keyed
"""

# missing values, NaN, infinities and a text column on the same rows
DIRTY = f"""
SELECT run_id, op, side, class, intensity,
       CASE WHEN l_partkey % 97 = 0 THEN NULL
            WHEN l_suppkey % 53 = 0 THEN CAST('NaN' AS DOUBLE) ELSE q END AS s1,
       CASE WHEN l_partkey % 211 = 0 THEN CAST('Infinity' AS DOUBLE)
            WHEN l_partkey % 223 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE e END AS s2,
       d AS s3, 42e0 AS s_const,
       CASE WHEN l_suppkey % 31 = 0 THEN 'n/a' ELSE CAST(CAST(q AS INT) AS STRING) END AS text
FROM ({_KEYED}) keyed
"""

# a nominal / failure pair with column names of every role
FAILURE_FRAME = f"""
SELECT class AS Failure, intensity AS Intensity, run_id, s1, s2, s3, s4, s_const, op AS status
FROM ({RUNS}) runs WHERE side = 'failure'
"""
NOMINAL_FRAME = f"""
SELECT run_id, s1, s2, s3, s4, s_const, op AS status, s1_dup
FROM ({RUNS}) runs WHERE side = 'nominal'
"""

# one operating point; view events are nominal, the others faults with k as intensity
EVENTS = """
SELECT CAST(event_id AS STRING) AS run_id, 'EV' AS op,
       CASE WHEN event_type = 'view' THEN 'nominal' ELSE 'failure' END AS side,
       CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS class,
       CASE WHEN event_type = 'view' THEN NULL ELSE {k} END AS intensity,
       value AS v, ln(1e0 + value) AS lv, CAST(user_id AS DOUBLE) AS u
FROM {events}
"""
_K = {"spark": "CAST(get_json_object(props, '$.k') AS DOUBLE)",
      "duckdb": "CAST(json_extract_string(props, '$.k') AS DOUBLE)"}

# file paths of several layouts, growing with the part table
PATHS = """
SELECT '/lake/' || CASE p_partkey % 5
    WHEN 0 THEN 'plant_' || CAST(p_partkey / 10 AS STRING) || '/nominal.csv'
    WHEN 1 THEN 'unit_' || CAST(p_size AS STRING) || '/OP_' || CAST(p_partkey AS STRING) || '_baseline.CSV'
    WHEN 2 THEN 'unit_' || CAST(p_size AS STRING) || '/OP_' || CAST(p_partkey - 1 AS STRING) || '_guasti.csv'
    WHEN 3 THEN 'flat/' || replace(p_name, ' ', '-') || '_' || CAST(p_partkey / 7 AS STRING) || '_tablefailures.csv'
    ELSE 'plant_' || CAST(p_partkey / 10 AS STRING) || '/failures.csv' END AS path
FROM {part}
"""
PATHS = PATHS.replace("p_partkey / 10", "(p_partkey - p_partkey % 10)").replace(
    "p_partkey / 7", "(p_partkey - p_partkey % 7)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("lineitem", "events", "part") if "{" + n + "}" in sql]
    sql = sql.replace("{k}", _K["spark"])
    out = spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})
    return out.withColumnRenamed("side", "set")


def duck(sql: str) -> str:
    sql = sql.replace("{k}", _K["duckdb"])
    for n in ("lineitem", "events", "part"):
        sql = sql.replace("{" + n + "}", n)
    return sql


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, RUNS)


def embeddings(spark: SparkSession, sf_dir: str, dims: int = 64) -> tuple[DataFrame, list[str]]:
    """One sensor per dimension; label 0 is nominal, the others are fault classes."""
    from pyspark.sql import functions as F

    names = [f"e{j}" for j in range(dims)]
    e = table(spark, sf_dir, "embeddings")
    nominal = F.col("label") == 0
    return e.select(
        F.col("vec_id").cast("string").alias("run_id"), F.lit("EM").alias("op"),
        F.when(nominal, "nominal").otherwise("failure").alias("set"),
        F.when(~nominal, F.col("label").cast("string")).alias("class"),
        F.when(~nominal, F.pmod("vec_id", F.lit(100)).cast("double")).alias("intensity"),
        *[F.col("embedding")[j].cast("double").alias(n) for j, n in enumerate(names)],
    ), names
