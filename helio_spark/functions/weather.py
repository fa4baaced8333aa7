"""Weather columns: canonical names, numeric coercion, text encoding."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: canonical names of weather columns, by lower-case input name
CANONICAL = {
    "ghi": "ghi",
    "ghi(w/m2)": "ghi",
    "dni": "dni",
    "dhi": "dhi",
    "temp": "temp",
    "temperature": "temp",
    "humidity": "humidity",
    "wind": "wind",
    "wind_speed": "wind_speed",
    "wind_deg": "wind_deg",
    "clouds": "clouds",
    "clouds_all": "clouds",
    "cloud_cover": "clouds",
    "rain_1h": "rain_1h",
    "lat": "lat",
    "lon": "lon",
}

# fixed values: sky clearness 0..10 by words in the text; the first match counts
SKY_CODES = (
    ("fog|mist|haze", 0.0),
    ("heavy|thunderstorm|storm|snow", 1.0),
    ("rain|drizzle", 2.0),
    ("scatter|mostly cloud", 6.0),
    ("few cloud|partly", 8.0),
    ("clear|sunny", 10.0),
    ("overcast|broken|cloud", 4.0),
)
UNKNOWN_SKY = 5.0


def canonical_name(name: str) -> str:
    return CANONICAL.get(name.lower(), name)


def standardize_names(df: DataFrame) -> DataFrame:
    """Rename weather columns; inputs that map to one name are coalesced."""
    sources = defaultdict(list)
    for c in df.columns:
        sources[canonical_name(c)].append(F.col(f"`{c}`"))
    return df.select(
        *[(cs[0] if len(cs) == 1 else F.coalesce(*cs)).alias(n) for n, cs in sources.items()]
    )


def to_number(c: Column) -> Column:
    """Double, with unparsable text and NaN as NULL."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def is_weather_text(name: str) -> bool:
    return "weather" in name.lower() and "description" in name.lower()


def coerce_numbers(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """All columns but ``keep`` and the weather text become clean doubles."""
    return df.select(
        *[
            F.col(f"`{c}`") if c in keep or is_weather_text(c)
            else to_number(F.col(f"`{c}`")).alias(c)
            for c in df.columns
        ]
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def sky_code(text: Column) -> Column:
    lower = F.lower(text)
    code = F.when(text.isNull(), UNKNOWN_SKY)
    for words, value in SKY_CODES:
        code = code.when(lower.rlike(words), value)
    return code.otherwise(UNKNOWN_SKY)


def encode_weather_text(df: DataFrame, col: str = "weather_description") -> DataFrame:
    return df.withColumn(col, sky_code(F.col(col))) if col in df.columns else df
