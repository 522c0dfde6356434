"""Privacy operators: coordinate coarsening, removal of
identifying keys from nested metadata, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCATION_COLUMNS = ["longitude", "latitude", "lon", "lat"]
# Fixed values of the reference: keys treated as identifying (case-insensitive).
SENSITIVE_KEYS = ["user_id", "farm_id", "owner_name", "contact_info", "exact_coordinates",
                  "property_address", "field_id"]


def anonymize_location(df: DataFrame, precision: float = 0.01) -> DataFrame:
    """X30 round coordinates to ``precision`` degrees (half-to-even, like
    numpy)."""
    return df.withColumns({c: F.bround(F.col(c) / precision, 0) * precision
                           for c in LOCATION_COLUMNS if c in df.columns})


def _is_sensitive(name: str) -> bool:
    return name.lower() in {k.lower() for k in SENSITIVE_KEYS}


def _clean(col: Column, dtype: T.DataType) -> Column:
    """Recursively drop sensitive struct fields / map keys."""
    if isinstance(dtype, T.StructType):
        drop = [f.name for f in dtype.fields if _is_sensitive(f.name)]
        out = col.dropFields(*drop) if drop else col
        for f in dtype.fields:
            if not _is_sensitive(f.name) and isinstance(f.dataType, (T.StructType, T.MapType)):
                out = out.withField(f.name, _clean(col.getField(f.name), f.dataType))
        return out
    if isinstance(dtype, T.MapType):
        lowered = [k.lower() for k in SENSITIVE_KEYS]
        out = F.map_filter(col, lambda k, v: ~F.lower(k).isin(lowered))
        if isinstance(dtype.valueType, (T.StructType, T.MapType)):
            vt = dtype.valueType
            out = F.transform_values(out, lambda k, v: _clean(v, vt))
        return out
    return col


def drop_sensitive(df: DataFrame) -> DataFrame:
    """X31 drop identifying top-level columns, struct fields and map keys at
    any depth; the schema walk happens at plan time."""
    keep = [f for f in df.schema.fields if not _is_sensitive(f.name)]
    return df.select(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in keep])


def row_hash(*cols) -> Column:
    """X32 md5 of the row's text form: each field as its length, ':' and its
    text, NULL as '-', so that different rows have different forms."""
    form = [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in form]))


def dataset_fingerprint(h: Column) -> Column:
    """Order-free dataset hash: exact sum of the 60-bit prefixes of the row
    md5s (an aggregate; partial sums combine map-side, nothing is gathered)."""
    return F.sum(F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
