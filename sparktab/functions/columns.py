"""Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import is_floating

# Text that delimited files hold for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TIMESTAMP_FORMATS = ("yyyy-M-d H:m:s", "M/d/yyyy H:m:s", "M/d/yyyy", "MMM d yyyy", "d MMM yyyy", "yyyy/M/d", "yyyyMMdd")


def finite(c: Column) -> Column:
    """The value as a double, null where it is none or not finite."""
    x = c.try_cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c.try_cast("double")) == F.lit(float("inf")), F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every floating column becomes null, so that one notion of missing holds."""
    names = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    return df.withColumns({n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in names}) if names else df


def as_timestamp(c: Column, kind: T.DataType) -> Column:
    """A timestamp without zone; text by ISO forms, then by TIMESTAMP_FORMATS; numbers aren't times."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    forms = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in TIMESTAMP_FORMATS]
    return F.coalesce(*forms).cast("timestamp_ntz")


def same_value(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType) -> Column:
    """Whether values of two columns are equal: numbers, and text against floating numbers, by value; other types as text."""
    if kind_a == kind_b:
        return a == b
    kinds = (kind_a, kind_b)
    if any(isinstance(k, (T.ArrayType, T.StructType, T.MapType)) for k in kinds):
        return F.lit(False)
    numbers = [isinstance(k, T.NumericType) for k in kinds]
    if all(numbers) and not any(map(is_floating, kinds)):
        return a == b
    if any(map(is_floating, kinds)) and all(n or isinstance(k, T.StringType) for n, k in zip(numbers, kinds, strict=True)):
        return F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))
    text = lambda c, k: F.initcap(c.cast("string")) if isinstance(k, T.BooleanType) else c.cast("string")
    return text(a, kind_a) == text(b, kind_b)


def normal_label(c: Column) -> Column:
    """'(missing)', '(blank)', or the text with white space collapsed, cut to 47 characters and an ellipsis."""
    text = F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " "))
    return F.when(c.isNull(), "(missing)").when(text == "", "(blank)").when(F.length(text) > 48, F.concat(F.substring(text, 1, 47), F.lit("…"))).otherwise(text)


def is_sha256(c: Column) -> Column:
    return c.rlike("^(sha256:)?[0-9a-fA-F]{64}$")


def strip_html(c: Column) -> Column:
    """Text of markup: scripts, styles and tags go, common entities return, white space collapses."""
    text = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


#: Where markup and style sheets name an address; its one group is the address.
EXTERNAL = r"""(?i)(?:\b(?:src|href|data|poster|action)\s*=\s*["']?|\burl\(\s*["']?|@import\s+["'])((?:https?:)?//[^"'\s>)]+)"""


def external_assets(c: Column) -> Column:
    """Addresses of another host, with or without a scheme, in src, href, data, poster and action, in CSS url() and @import."""
    return F.regexp_extract_all(c, F.lit(EXTERNAL), F.lit(1))


def row_digest(columns: list[str]) -> Column:
    """sha256 of the values as text: each stands behind its length and a colon, a null is a dash, so no two rows that differ
    in nulls, or in where one value ends, read alike."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts), 256)


def tokenise(c: Column, least: int = 3) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text, least characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= least)))


def is_zoned_time(c: Column) -> Column:
    """Whether text is an ISO 8601 time with a zone that exists in the calendar."""
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(shaped & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def numbers_in(c: Column) -> Column:
    """The numbers written in a text (signs, decimals, exponents; per cent as hundredths), as doubles."""
    found = F.regexp_extract_all(c, F.lit(r"([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?%?)"), F.lit(1))
    return F.transform(found, lambda x: F.when(x.endswith("%"), F.rtrim(x, F.lit("%")).try_cast("double") / 100).otherwise(x.try_cast("double")))


def json_keys(c: Column) -> Column:
    """The top-level keys of a JSON object, sorted."""
    return F.array_sort(F.json_object_keys(c))


def truncate_middle(c: Column, most: int) -> Column:
    """Text of at most so many characters, the middle left out."""
    head = (most - 1) // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(most - 1 - head))))
