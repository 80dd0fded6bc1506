"""Small value expressions: dates, ids, defaults, typed attributes, list batches."""

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.model import PROCESS_DATE_FORMAT, REASONS


def process_date(ts: Column) -> Column:
    return F.date_format(ts, PROCESS_DATE_FORMAT)


def parse_process_date(text: Column) -> Column:
    """Null for an empty or malformed date."""
    return F.try_to_timestamp(text, F.lit(PROCESS_DATE_FORMAT))


def epoch_string(ts: Column) -> Column:
    """Epoch seconds as float text such as 1700000000.0, with the microseconds that are set. Null gives ''."""
    micros = F.unix_micros(ts.cast("timestamp"))
    fraction = F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
    shown = F.regexp_replace(fraction, "(?<=.)0+$", "")
    whole = F.floor(micros / 1_000_000).cast("string")
    return F.coalesce(F.concat(whole, F.lit("."), shown), F.lit(""))


def parse_epoch(text: Column) -> Column:
    return F.timestamp_micros(F.round(text.try_cast("decimal(20,6)") * 1_000_000).cast("bigint"))


def uuid_of(natural_key: Column) -> Column:
    """Deterministic uuid text from a natural key, so that a re-run gives the same id."""
    h = F.md5(natural_key.cast("binary"))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )


def organization_id(uuid_text: Column) -> Column:
    """Collection-safe id: only digits, letters and underscores."""
    return F.concat(F.lit("p_"), F.replace(uuid_text, F.lit("-"), F.lit("_")))


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def invite_link(user_id: Column, register_url: str = "https://example.com/register?id=") -> Column:
    return F.concat(F.lit(register_url), user_id)


def reason_code(name: str) -> Column:
    return F.lit(REASONS[name][0]).cast("bigint")


def reason_text(name: str) -> Column:
    return F.lit(REASONS[name][1])


def outcome(*rules: tuple[Column, str]) -> tuple[Column, Column]:
    """(code, reason) of the first rule whose condition holds; both null when none does."""
    code, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    for condition, name in reversed(rules):
        code = F.when(condition, reason_code(name)).otherwise(code)
        text = F.when(condition, reason_text(name)).otherwise(text)
    return code, text


def _default(value: Any, data_type: str) -> Column:
    if value == []:
        return F.array().cast(data_type)
    if value == {}:
        return F.from_json(F.lit("{}"), data_type) if data_type.startswith("map") else F.map_from_arrays(F.array(), F.array())
    return F.lit(value).cast(data_type)


def with_defaults(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Project to the model's fields; a missing column or a null becomes the field's default."""
    types = dict(df.dtypes)
    empty_types = {"list": "array<string>", "dict": "map<string,string>", "str": "string", "int": "bigint", "bool": "boolean"}
    out = []
    for name, value in defaults.items():
        data_type = types.get(name, empty_types[type(value).__name__])
        if name in types:
            out.append(F.coalesce(F.col(name), _default(value, data_type)).alias(name))
        else:
            out.append(_default(value, data_type).alias(name))
    return df.select(*out)


def array_batches(items: Column, size: int) -> Column:
    """An array cut into arrays of `size`; an empty array has no batches."""
    n = F.ceil(F.size(items) / size).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(items, i * size + 1, F.lit(size))
    )
    return F.filter(cut, lambda b: F.size(b) > 0)


def typed_schema(fields: dict[str, str]) -> str:
    """Schema of a typed-attribute record; `fields` maps a name to its tag: S, N, BOOL, L (of S) or M (of S)."""
    shapes = {
        "S": "struct<S:string>",
        "N": "struct<N:string>",
        "BOOL": "struct<BOOL:boolean>",
        "L": "struct<L:array<struct<S:string>>>",
        "M": "struct<M:map<string,struct<S:string>>>",
    }
    return "struct<" + ",".join(f"`{n}`:{shapes[t]}" for n, t in fields.items()) + ">"


def from_typed(text: Column, fields: dict[str, str]) -> list[Column]:
    """Plain columns out of a typed-attribute JSON record."""
    record = F.from_json(text, typed_schema(fields))
    out = []
    for name, tag in fields.items():
        value = record.getField(name).getField(tag)
        if tag == "N":
            value = value.try_cast("bigint")
        elif tag == "L":
            value = F.transform(value, lambda v: v.getField("S"))
        elif tag == "M":
            value = F.transform_values(value, lambda _, v: v.getField("S"))
        out.append(value.alias(name))
    return out


def to_typed(fields: dict[str, str]) -> Column:
    """Typed-attribute JSON record of the named columns."""
    out = []
    for name, tag in fields.items():
        value = F.col(name)
        if tag == "N":
            value = value.cast("string")
        elif tag == "L":
            value = F.transform(value, lambda v: F.struct(v.alias("S")))
        elif tag == "M":
            value = F.transform_values(value, lambda _, v: F.struct(v.alias("S")))
        out.append(F.struct(value.alias(tag)).alias(name))
    return F.to_json(F.struct(*out))
