"""Parameter grids and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from helio_spark.catalog.inputs import table, tidy
from helio_spark.catalog.registry import query
from helio_spark.plans.search import best_trial, leaderboard, parameter_grid, remaining

# fixed values: sample parameter grid
GRID = {"hidden_size": [16, 32, 64], "dropout": [0.1, 0.2, 0.4], "batch_size": [32, 64]}
_GRID_SQL = """
    gr AS (SELECT row_number() OVER (ORDER BY a, b, c) AS run_id, [16, 32, 64][a]::BIGINT AS hidden_size,
                  [0.1, 0.2, 0.4][b]::DOUBLE AS dropout, [32, 64][c]::BIGINT AS batch_size
           FROM (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([1, 2, 3]) AS b),
                (SELECT unnest([1, 2]) AS c))"""
# one trial per part
_TRIALS_SQL = """
    tr AS (SELECT l_partkey AS run_id, avg(l_extendedprice) / 8241 AS rmse,
                  CASE WHEN l_partkey % 6 = 0 THEN 'failed' ELSE 'ok' END AS status
           FROM lineitem GROUP BY 1)"""


def _trials(spark, sf_dir):
    """One trial per part: its mean line price stands for the score."""
    status = F.when(F.col("run_id") % 6 == 0, "failed").otherwise("ok")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("run_id"))
        .agg((F.avg("l_extendedprice") / 8241).alias("rmse"))
        .withColumn("status", status)
    )


@query(
    "grid_remaining",
    f"""
    WITH {_GRID_SQL},
    done AS (SELECT DISTINCT [16, 32, 64][l_linenumber % 3 + 1] AS hidden_size,
                    [0.1, 0.2, 0.4][l_suppkey % 3 + 1]::DOUBLE AS dropout, 32 AS batch_size
             FROM lineitem WHERE l_linenumber <> 2)
    SELECT run_id, hidden_size, dropout, batch_size FROM gr
    WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.hidden_size = gr.hidden_size
                        AND d.dropout = gr.dropout AND d.batch_size = gr.batch_size)""",
)
def grid_remaining(spark, sf_dir):
    def pick(values, place):
        return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))

    done = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linenumber") != 2)
        .select(
            pick(GRID["hidden_size"], F.col("l_linenumber")).alias("hidden_size"),
            pick(GRID["dropout"], F.col("l_suppkey")).alias("dropout"),
            F.lit(32).alias("batch_size"),
        )
    )
    return tidy(remaining(parameter_grid(spark, GRID), done, list(GRID)))


@query(
    "leaderboard",
    f"""
    WITH {_TRIALS_SQL}
    SELECT run_id, round(rmse, 6) + 0.0 AS rmse, status,
           round((1 - rmse / 5) * 100, 6) + 0.0 AS improvement_pct
    FROM tr WHERE status <> 'failed'""",
)
def board(spark, sf_dir):
    return tidy(leaderboard(_trials(spark, sf_dir), baseline=5.0))


@query(
    "best_trial",
    f"""
    WITH {_TRIALS_SQL}
    SELECT run_id, round(rmse, 6) + 0.0 AS rmse, status FROM tr WHERE status <> 'failed'
    ORDER BY tr.rmse, run_id LIMIT 1""",
)
def top_trial(spark, sf_dir):
    return tidy(best_trial(_trials(spark, sf_dir)))
