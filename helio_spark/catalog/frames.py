"""Lag, rolling, lead, window, split and scaling queries."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio_spark.catalog.inputs import HORIZON, HOURLY_SQL, RAW_SQL, SPLIT_SQL, hourly, raw, rounded, tidy
from helio_spark.catalog.registry import query
from helio_spark.operators.framing import (
    first_per_horizon,
    latest_origin,
    make_encoder_samples,
    make_fusion_windows,
    make_windows,
)
from helio_spark.operators.history import (
    DEFAULT_LAGS,
    DEFAULT_ROLLS,
    add_future_covariates,
    add_lags,
    add_rolling_means,
    add_rolling_vars,
    add_targets,
    fill_future_covariates,
)
from helio_spark.operators.scaling import apply_scaler, fit_scaler, scale_target
from helio_spark.session import shared_dir
from helio_spark.sources.windows import read_windows, write_windows
from helio_spark.operators.splits import head_share, split_rows, split_windows, walk_forward

_ORDER = "PARTITION BY series_id ORDER BY time_idx"
_KEYS = ["series_id", "ts", "time_idx"]


def _over(expr: str, name: str, frame: str = "") -> str:
    return f"{expr} OVER ({_ORDER}{' ' + frame if frame else ''}) AS {name}"


def _last(width: int) -> str:
    return f"ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW"


@query(
    "lags",
    f"WITH {RAW_SQL} SELECT series_id, ts, time_idx, "
    + rounded("pv", *[_over(f"lag(pv, {n})", f"pv_lag{n}") for n in DEFAULT_LAGS])
    + " FROM r",
)
def lags(spark, sf_dir):
    return tidy(add_lags(raw(spark, sf_dir).select(*_KEYS, "pv"), ["pv"]))


def _guarded(agg: str, col: str, width: int, name: str) -> str:
    frame = f"({_ORDER} {_last(width)})"
    return (
        f"CASE WHEN count({col}) OVER {frame} >= {max(1, width // 2)} "
        f"THEN {agg}({col}) OVER {frame} END AS {name}"
    )


# a missing value in every fifth row exercises the minimum number of values
_GAPPY_SQL = f"{RAW_SQL}, g AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN pv END AS x FROM r)"


def _gappy(spark, sf_dir):
    x = F.when(F.col("event_id") % 5 != 0, F.col("pv")).alias("x")
    return raw(spark, sf_dir).select(*_KEYS, x)


@query(
    "rolling_mean",
    f"WITH {_GAPPY_SQL} SELECT series_id, ts, time_idx, "
    + rounded("x", *[_guarded("avg", "x", n, f"x_roll{n}h") for n in DEFAULT_ROLLS])
    + " FROM g",
)
def rolling_mean(spark, sf_dir):
    return tidy(add_rolling_means(_gappy(spark, sf_dir), ["x"]))


@query(
    "rolling_mean_generic",
    f"WITH {_GAPPY_SQL} SELECT series_id, ts, time_idx, "
    + rounded("x", *[_guarded("avg", "x", n, f"x_roll{n}m") for n in (15, 60)])
    + " FROM g",
)
def rolling_mean_generic(spark, sf_dir):
    return tidy(add_rolling_means(_gappy(spark, sf_dir), ["x"], [15, 60], unit="m"))


@query(
    "rolling_var",
    f"WITH {_GAPPY_SQL} SELECT series_id, ts, time_idx, "
    + rounded("x", *[_guarded("var_pop", "x", n, f"x_var{n}h") for n in DEFAULT_ROLLS])
    + " FROM g",
)
def rolling_var(spark, sf_dir):
    return tidy(add_rolling_vars(_gappy(spark, sf_dir), ["x"]))


@query(
    "supervised_targets",
    f"WITH {RAW_SQL} SELECT series_id, ts, time_idx, "
    + rounded("pv", *[_over(f"lead(pv, {h})", f"target_h{h}") for h in range(1, 25)])
    + " FROM r",
)
def supervised_targets(spark, sf_dir):
    return tidy(add_targets(raw(spark, sf_dir).select(*_KEYS, "pv"), 24))


_AHEAD = range(1, HORIZON + 1)


@query(
    "future_covariates",
    f"WITH {RAW_SQL} SELECT series_id, ts, time_idx, "
    + rounded("value", "pv", *[_over(f"lead({c}, {h})", f"{c}_fut_h{h}") for c in ("value", "pv") for h in _AHEAD])
    + " FROM r",
)
def future_covariates(spark, sf_dir):
    rows = raw(spark, sf_dir).select(*_KEYS, "value", "pv")
    return tidy(add_future_covariates(rows, ["value", "pv", "clouds"], HORIZON))


@query(
    "covariate_fallback",
    f"""
    WITH {RAW_SQL},
    g AS (SELECT series_id, ts, time_idx, value, CASE WHEN event_id % 3 > 0 THEN pv END AS pv FROM r),
    last AS (SELECT series_id, arg_max(value, time_idx) AS last_value,
                    arg_max(pv, time_idx) FILTER (WHERE pv IS NOT NULL) AS last_pv
             FROM g GROUP BY 1),
    f AS (SELECT *, """
    + ", ".join(_over(f"lead({c}, {h})", f"{c}_f{h}") for c in ("value", "pv") for h in _AHEAD)
    + """ FROM g)
    SELECT series_id, ts, time_idx, """
    + rounded("value", "pv", *[f"coalesce({c}_f{h}, last_{c}) AS {c}_fut_h{h}" for c in ("value", "pv") for h in _AHEAD])
    + " FROM f JOIN last USING (series_id)",
)
def covariate_fallback(spark, sf_dir):
    known = F.when(F.col("event_id") % 3 > 0, F.col("pv")).alias("pv")
    rows = raw(spark, sf_dir).select(*_KEYS, "value", known)
    ahead = add_future_covariates(rows, ["value", "pv"], HORIZON)
    return tidy(fill_future_covariates(ahead, ["value", "pv"], HORIZON))


# windows of a week and a day; each of their values goes into a digest of its window
SEQ_LEN = 168
_BACK, _FORE = f"ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW", f"ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING"


_DIGEST_ROWS = 1_024


def _digests(made: DataFrame, keep: list[str], columns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """``keep`` and for each of ``columns`` the MD5 of an array's values, or of one field of its structs, in millionths.

    In Arrow batches: a lambda over an array is interpreted, several times slower a value than the windows themselves.
    A value is in many windows of a batch: each is written as text once, and the windows' texts are put together from those.
    """

    def md5s(lists: pa.ListArray) -> list[str]:
        """Nulls are left out, NaN is 0, the ends of 64 bits hold."""
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        values = lists.flatten()
        if values.null_count:
            known = values.is_valid().to_numpy(zero_copy_only=False)
            ends, values = np.concatenate([[0], np.cumsum(known)])[ends], values.drop_null()
        coded = values.dictionary_encode()
        units = np.floor(coded.dictionary.to_numpy(zero_copy_only=False).astype(np.float64) * 1e6 + 0.5)
        inside = np.abs(units) < 2.0**63
        whole = np.where(inside, units, 0.0).astype(np.int64)
        if not inside.all():
            whole[units >= 2.0**63], whole[units <= -(2.0**63)] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        texts = pc.binary_join_element_wise(pa.array(whole).cast(pa.string()), "", ",")  # a comma after each
        _, starts, data = texts.take(coded.indices).buffers()
        if not len(values):
            return [hashlib.md5(b"").hexdigest()] * len(lists)
        at = np.frombuffer(starts, np.int32)[ends].tolist()
        text = memoryview(data)
        return [hashlib.md5(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _DIGEST_ROWS):
                part = batch.slice(a, _DIGEST_ROWS)
                made = [pa.array(md5s(part.column(name)), pa.string()) for name in columns]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], [*keep, *columns])

    arrays = [(F.col(array) if field is None else F.col(array)[field]).alias(name) for name, (array, field) in columns.items()]
    schema = [f"`{c}` {made.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` string" for c in columns]
    return tidy(made.select(*keep, *arrays).mapInArrow(run, ", ".join(schema)))


def _digest_sql(col: str, window: str) -> str:
    units = f"CAST(floor(CAST(CAST({col} AS FLOAT) AS DOUBLE) * 1e6 + 0.5) AS BIGINT)"
    return f"md5(array_to_string(list({units}) OVER ({window}), ','))"


def _windows_sql(columns: dict[str, tuple[str, str]], order: str = _ORDER, source: str = "r", more: str = "") -> str:
    made = ", ".join(f"{_digest_sql(c, f'{order} {frame}')} AS {name}" for name, (c, frame) in columns.items())
    return f"""
    d AS (SELECT series_id{more}, ts AS origin_ts, time_idx, row_number() OVER ({order}) AS place,
                 count(*) OVER ({order.split(' ORDER')[0]}) AS k, {made} FROM {source})
    SELECT series_id{more}, origin_ts, time_idx, {', '.join(columns)} FROM d
    WHERE place >= {SEQ_LEN} AND place + {HORIZON} <= k"""


_PLAIN = {"x_pv": ("pv", _BACK), "x_value": ("value", _BACK), "y_pv": ("pv", _FORE)}


def _plain_digests(made):
    return _digests(made, ["series_id", "origin_ts", "time_idx"], {"x_pv": ("x", "pv"), "x_value": ("x", "value"), "y_pv": ("y", None)})


@query("windows", f"WITH {RAW_SQL}, {_windows_sql(_PLAIN)}")
def windows(spark, sf_dir):
    """A window of 168 rows and 24 targets for every event that has them."""
    return _plain_digests(make_windows(raw(spark, sf_dir), ["pv", "value"], SEQ_LEN, HORIZON, by_column=True))


@query("window_store", f"WITH {RAW_SQL}, {_windows_sql(_PLAIN)}")
def window_store(spark, sf_dir):
    """The same windows, stored as blocks of rows with a halo and unrolled by the reader."""
    path = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    write_windows(raw(spark, sf_dir), path, ["pv", "value"], SEQ_LEN, HORIZON)
    return _plain_digests(read_windows(spark, path))


_FUSION = {
    "past_pv": ("pv", _BACK), "past_value": ("value", _BACK), "past_user": ("user_id", _BACK),
    "future_value": ("value", _FORE), "future_user": ("user_id", _FORE), "target": ("pv", _FORE),
}


@query("fusion_windows", f"WITH {RAW_SQL}, {_windows_sql(_FUSION)}")
def fusion_windows(spark, sf_dir):
    """The three branches and the target."""
    made = make_fusion_windows(raw(spark, sf_dir), ["value", "user_id"], SEQ_LEN, HORIZON, by_column=True)
    return _digests(made, ["series_id", "origin_ts", "time_idx"], {
        "past_pv": ("x_target", None), "past_value": ("x_weather", "value"), "past_user": ("x_weather", "user_id"),
        "future_value": ("x_future", "value"), "future_user": ("x_future", "user_id"), "target": ("y", None),
    })


_BY_SPLIT = "PARTITION BY series_id, split ORDER BY time_idx"
_ENCODER = {
    "encoder_value": ("value", _BACK), "encoder_user": ("user_id", _BACK), "encoder_pv": ("pv", _BACK),
    "decoder_value": ("value", _FORE), "y_pv": ("pv", _FORE),
}
_ENCODER_SQL = f"WITH {RAW_SQL}, {SPLIT_SQL.format(t='r')}, {_windows_sql(_ENCODER, _BY_SPLIT, 'sp', ', split')}".replace(
    "SELECT series_id, split, origin_ts, time_idx, enc", "SELECT series_id, split, time_idx, enc"
)


def _encoder_digests(made, encoder, decoder):
    return _digests(made, ["series_id", "split", "time_idx"], {
        "encoder_value": (encoder, "value"), "encoder_user": (encoder, "user_id"), "encoder_pv": (encoder, "pv"),
        "decoder_value": (decoder, "value"), "y_pv": ("y", None),
    })


@query("encoder_samples", _ENCODER_SQL)
def encoder_samples(spark, sf_dir):
    rows = split_rows(raw(spark, sf_dir))
    made = make_encoder_samples(rows, known=["value"], unknown=["user_id"], seq_len=SEQ_LEN, horizon=HORIZON, by_column=True)
    return _encoder_digests(made, "encoder", "decoder")


@query("encoder_store", _ENCODER_SQL)
def encoder_store(spark, sf_dir):
    """Encoder and decoder rows from stored blocks; a block lies within one split."""
    path = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    rows = split_rows(raw(spark, sf_dir))
    write_windows(rows, path, ["value", "user_id", "pv"], SEQ_LEN, HORIZON, ahead=["value"], keys=["series_id", "split"])
    return _encoder_digests(read_windows(spark, path), "x", "x_ahead")


@query(
    "split_rows",
    f"WITH {RAW_SQL}, {SPLIT_SQL.format(t='r')} SELECT series_id, ts, time_idx, split FROM sp",
)
def rows_split(spark, sf_dir):
    return tidy(split_rows(raw(spark, sf_dir).select(*_KEYS)))


@query(
    "split_rows_purged",
    f"""
    WITH {RAW_SQL},
    m AS (SELECT series_id, max(time_idx) AS top FROM r GROUP BY 1),
    c AS (SELECT r.series_id, ts, time_idx, CAST(floor(top * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a,
                 CAST(floor(top * CAST(0.8 AS DOUBLE)) AS BIGINT) AS b
          FROM r JOIN m USING (series_id))
    SELECT series_id, ts, time_idx,
           CASE WHEN time_idx > b THEN 'test'
                WHEN time_idx > a THEN CASE WHEN time_idx > b - 24 THEN 'purged' ELSE 'val' END
                WHEN time_idx > a - 24 THEN 'purged' ELSE 'train' END AS split
    FROM c""",
)
def rows_purged(spark, sf_dir):
    return tidy(split_rows(raw(spark, sf_dir).select(*_KEYS), purge=24))


@query(
    "split_windows",
    f"""
    WITH {RAW_SQL},
    m AS (SELECT series_id, count(*) - 168 - 24 + 1 AS k FROM r GROUP BY 1),
    o AS (SELECT r.series_id, ts, time_idx, time_idx - 167 AS window_no,
                 CAST(floor(k * CAST(0.7 AS DOUBLE)) AS BIGINT) AS a,
                 CAST(floor(k * CAST(0.1 AS DOUBLE)) AS BIGINT) AS b, k
          FROM r JOIN m USING (series_id))
    SELECT series_id, ts, time_idx, window_no,
           CASE WHEN window_no < a THEN 'train' WHEN window_no < a + b THEN 'val' ELSE 'test' END AS split
    FROM o WHERE window_no >= 0 AND window_no < k""",
)
def windows_split(spark, sf_dir):
    return tidy(split_windows(raw(spark, sf_dir).select(*_KEYS), 168, 24))


@query(
    "head_share",
    f"""
    WITH {RAW_SQL}, m AS (SELECT series_id, count(*) AS k FROM r GROUP BY 1)
    SELECT r.series_id, ts, time_idx FROM r JOIN m USING (series_id)
    WHERE time_idx < CAST(floor(k * CAST(0.7 AS DOUBLE)) AS BIGINT)""",
)
def head(spark, sf_dir):
    return tidy(head_share(raw(spark, sf_dir).select(*_KEYS), 0.7))


FOLDS_SQL = """
    n AS (SELECT series_id, count(*) AS k FROM {t} GROUP BY 1),
    fb AS (SELECT series_id, k, f.fold, greatest(1, CAST(floor(k * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS len,
                  greatest(24, CAST(floor(k * CAST(0.5 AS DOUBLE)) AS BIGINT)) AS start
           FROM n CROSS JOIN (SELECT unnest(generate_series(1, 5)) AS fold) f),
    fo AS (SELECT series_id, fold, start + (fold - 1) * len AS train_end, start + fold * len AS val_end
           FROM fb WHERE start + fold * len < k)"""


@query(
    "walk_forward_folds",
    f"""
    WITH {RAW_SQL}, {FOLDS_SQL.format(t='r')}
    SELECT r.series_id, r.time_idx, fold, CASE WHEN r.time_idx < train_end THEN 'train' ELSE 'val' END AS role
    FROM r JOIN fo ON fo.series_id = r.series_id AND r.time_idx < fo.val_end""",
)
def folds(spark, sf_dir):
    rows = raw(spark, sf_dir).select("series_id", "time_idx")
    return tidy(walk_forward(rows, 5).select("series_id", "time_idx", "fold", "role"))


@query(
    "scale_standard",
    f"""
    WITH {RAW_SQL},
    m AS (SELECT series_id, CAST(floor((count(*) - 168 - 24 + 1) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS t
          FROM r GROUP BY 1),
    w AS (SELECT pv, value, greatest(0, least(time_idx, t - 1) - greatest(0, time_idx - 167) + 1) AS k
          FROM r JOIN m USING (series_id)),
    s AS (SELECT sum(pv * k) / sum(k) AS mp, sum(value * k) / sum(k) AS mv FROM w),
    d AS (SELECT mp, mv, sqrt(sum(k * (pv - mp) ** 2) / sum(k)) AS sp,
                 sqrt(sum(k * (value - mv) ** 2) / sum(k)) AS sv FROM w CROSS JOIN s GROUP BY 1, 2)
    SELECT series_id, ts, time_idx,
           {rounded('(pv - mp) / sp AS pv', '(value - mv) / sv AS value')}
    FROM r CROSS JOIN d""",
)
def scale_standard(spark, sf_dir):
    rows = raw(spark, sf_dir).select(*_KEYS, "pv", "value")
    scaler = fit_scaler(rows, ["pv", "value"], seq_len=168, horizon=24)
    return tidy(apply_scaler(rows, scaler, ["pv", "value"]))


@query(
    "scale_group",
    f"""
    WITH {RAW_SQL}, s AS (SELECT series_id, avg(pv) AS m, stddev_samp(pv) AS d FROM r GROUP BY 1)
    SELECT series_id, ts, time_idx, {rounded('(pv - m) / d AS pv_scaled')}
    FROM r JOIN s USING (series_id)""",
)
def scale_group(spark, sf_dir):
    scaled = scale_target(raw(spark, sf_dir).select(*_KEYS, "pv"))
    return tidy(scaled.select(*_KEYS, "pv_scaled"))


@query(
    "latest_origin",
    f"""
    WITH {RAW_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn
                          FROM r WHERE event_id % 4 <> 0)
    SELECT series_id, ts, time_idx, {rounded('pv')} FROM k WHERE rn = 1""",
)
def newest(spark, sf_dir):
    """Newest row with a value; every fourth value is missing."""
    rows = raw(spark, sf_dir).select(*_KEYS, F.when(F.col("event_id") % 4 != 0, F.col("pv")).alias("pv"))
    return tidy(latest_origin(rows))


@query(
    "first_per_horizon",
    f"""
    WITH {RAW_SQL}, f AS (SELECT series_id, event_id % 24 + 1 AS horizon_h, time_idx,
                                 CASE WHEN user_id % 2 = 0 THEN value END AS y_pred FROM r)
    SELECT series_id, horizon_h, min(time_idx) AS time_idx,
           arg_min(y_pred, time_idx) FILTER (WHERE y_pred IS NOT NULL) AS y_pred
    FROM f GROUP BY 1, 2""",
)
def first_rows(spark, sf_dir):
    rows = raw(spark, sf_dir).select(
        "series_id",
        (F.col("event_id") % 24 + 1).alias("horizon_h"),
        "time_idx",
        F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("y_pred"),
    )
    return tidy(first_per_horizon(rows))
