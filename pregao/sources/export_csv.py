"""CSV order exports."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregao.functions.headers import snake_case

LATIN1 = "ISO-8859-1"

# Field texts that mean "missing" in an export.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Columns the analytics use. Any other column passes through as text.
COLUMN_TYPES = {
    "data": "date",
    "datahora": "timestamp_ntz",
    "quantidade": "bigint",
    "preco": "double",
    "bruto": "double",
    "liquido": "double",
    "duracao": "bigint",
}


# Holds the whole record where it has more or fewer fields than the header.
_RECORD = "_record"


def read_export(
    spark: SparkSession,
    path: str | list[str],
    *,
    encoding: str = LATIN1,
    date_format: str | None = None,
    timestamp_format: str | None = None,
    types: Mapping[str, str] | None = None,
    multi_line: bool = False,
    infer: bool = False,
) -> DataFrame:
    """Read one or many exports with a header line into a typed ledger.

    Every field is read as text, missing tokens become NULL, and columns are cast. Short
    records end in NULLs. A record with more fields than the header, a file with another
    header, or a value that does not parse stops the job; the last is noticed
    only when the value's column is computed, so ``count`` alone passes over it.

    Dates are ISO, or month first when written with slashes, unless a format is given. Columns
    beyond the known ones stay text. With ``infer``, one aggregate over all files looks at the
    values first: a date column that mixes both forms is refused, and other columns get
    a type that all their values have: ``bigint`` for whole numbers if none is missing, else
    ``double``; ``boolean`` if none is missing; ``double`` for a column without any value; text otherwise.

    Whole numbers may be written ``100.0``. ``types``
    overrides column types, for instance ``{"quantidade": "double"}``. Quoted line breaks need
    ``multi_line``, which stops Spark from splitting files. Headers that are blank
    or equal up to case are taken by position, from a single file only.
    """
    options = {"encoding": encoding, "escape": '"', "multiLine": multi_line}
    files = spark.read.options(**options).csv(path)
    first = files.first()
    if first is None:
        raise ValueError(f"no header line in {path}")
    headers = ["" if h is None else h for h in first]
    names = [snake_case(h) for h in _named(headers)]
    repeated = [n for n, times in Counter(names).items() if times > 1 and n in COLUMN_TYPES]
    if repeated:
        raise ValueError(f"several headers give the same column: {repeated}")

    # With distinct headers Spark checks each file's header line against the first one.
    distinct = len({h.lower() for h in headers}) == len(headers) and all(headers)
    if not distinct and len(files.inputFiles()) > 1:
        raise ValueError(f"headers that repeat or are blank cannot be checked over several files: {headers}")
    fields = headers if distinct else [f"c{i}" for i in range(len(headers))]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, _RECORD]])
    text = (
        spark.read.options(**options)
        .options(header=True, enforceSchema=not distinct, columnPruning=False, columnNameOfCorruptRecord=_RECORD)
        .schema(schema)
        .csv(path)
        .toDF(*[f"c{i}" for i in range(len(names))], _RECORD)
        .where(_no_surplus(len(names)))
    )

    wanted = {**COLUMN_TYPES, **(types or {})}
    formats = {"date": date_format, "timestamp_ntz": timestamp_format}
    present = text.select(*[_present(c) for c in text.columns if c != _RECORD])
    if infer:
        dated = {f"c{i}": headers[i] for i, n in enumerate(names) if wanted.get(n) in formats and not formats[wanted[n]]}
        unknown = {f"c{i}": n for i, n in enumerate(names) if n not in wanted}
        wanted |= _looked_at(present, dated, unknown)
    columns = []
    for i, name in enumerate(names):
        field, kind = F.col(f"c{i}"), wanted.get(name)
        column = _parsed(field, kind, formats.get(kind), headers[i]) if kind else field
        columns.append(column.alias(name))
    return present.select(*columns)


# A whole number, any number, a truth value, and a date with slashes.
_WHOLE = r"^[+-]?\d+$"
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"
_TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"
_SLASHED = r"^\d{1,2}/\d{1,2}/\d{4}($| )"


def _looked_at(present: DataFrame, dated: Mapping[str, str], unknown: Mapping[str, str]) -> dict[str, str]:
    """The types of ``unknown`` columns, after a check that none of the ``dated`` ones mixes forms.

    Each column has a few tests that hold for all its values or not. They combine in any
    order, so one aggregate over all files and tasks joins the types that the files have.
    """
    found = []
    for c in dated:
        slashed = F.col(c).rlike(_SLASHED)
        found += [F.min(F.when(slashed, F.col(c))).alias(f"{c}_slashed"), F.min(F.when(~slashed, F.col(c))).alias(f"{c}_iso")]
    for c in unknown:
        whole = F.col(c).rlike(_WHOLE) & F.col(c).try_cast("bigint").isNotNull()
        # A whole number too large for BIGINT stays text, so that no digit is lost.
        number = whole | (F.col(c).rlike(_NUMBER) & ~F.col(c).rlike(_WHOLE))
        found += [F.every(test).alias(f"{c}_{name}") for name, test in (("whole", whole), ("number", number), ("truth", F.col(c).rlike(_TRUTH)))]
        found.append(F.count_if(F.col(c).isNull()).alias(f"{c}_missing"))
    if not found:
        return {}
    seen = present.agg(*found).first()
    for c, header in dated.items():
        slashed, iso = seen[f"{c}_slashed"], seen[f"{c}_iso"]
        if slashed is not None and iso is not None:
            raise ValueError(f"{header} mixes dates with slashes, such as {slashed}, and ISO dates, such as {iso}; a format can be given")
    kinds = {}
    for c, name in unknown.items():
        whole, number, truth, missing = (seen[f"{c}_{t}"] for t in ("whole", "number", "truth", "missing"))
        if whole and not missing:
            kinds[name] = "bigint"
        elif number or (number is None and missing):
            kinds[name] = "double"
        elif truth and not missing:
            kinds[name] = "boolean"
    return kinds


def _no_surplus(fields: int) -> Column:
    """True, or an error for a record that has more fields than the header.

    Only records of another length than the header come with their text; their
    commas are counted after blanking out quoted fields, empty surplus ones included.
    """
    bare = F.regexp_replace(F.col(_RECORD), r'(?s)(^|,)"(?:[^"]|"")*"(?=,|\r?\n?$)', "$1")
    commas = F.length(bare) - F.length(F.translate(bare, ",", ""))
    surplus = F.col(_RECORD).isNotNull() & (commas >= fields)
    refused = F.raise_error(F.concat(F.lit(f"more than the {fields} fields of the header: "), F.col(_RECORD)))
    # Always true; Spark does not answer queries that need nothing but the record.
    read = F.length(F.coalesce(F.col("c0"), F.lit(""))) >= 0
    return F.when(surplus, refused.cast("boolean")).otherwise(read)


def _named(headers: list[str]) -> list[str]:
    """Give blank headers a name by position and number the repeats of a header."""
    seen: Counter[str] = Counter()
    named = []
    for i, header in enumerate(headers):
        header = header or f"Unnamed: {i}"
        named.append(f"{header}.{seen[header]}" if seen[header] else header)
        seen[header] += 1
    return named


def _present(name: str) -> Column:
    return F.when(~F.col(name).isin(*MISSING_TOKENS), F.col(name)).alias(name)


def _parsed(field: Column, kind: str, given: str | None, header: str) -> Column:
    """The typed value; a text that is none stops the job, in ANSI mode or not."""
    hint = ""
    if kind == "date":
        value = F.try_to_date(field, given) if given else _iso(field).try_cast(kind)
        hint = "" if given else "; a date_format can be given"
    elif kind == "timestamp_ntz":
        value = F.try_to_timestamp(field, F.lit(given)).cast(kind) if given else _iso(field).try_cast(kind)
        hint = "" if given else "; a timestamp_format can be given"
    elif kind == "bigint":
        exact = field.try_cast("decimal(38,10)")
        value = F.coalesce(field.try_cast(kind), F.when(exact == F.floor(exact), exact.cast(kind)))
    else:
        value = field.try_cast(kind)
    said = F.concat(F.lit(f"{header}: not a {kind}: "), field, F.lit(hint))
    return F.coalesce(value, F.when(field.isNotNull(), F.raise_error(said).cast(kind)))


def _iso(field: Column) -> Column:
    """Month-first slashes as an ISO date, with the time of day, if any, to the second."""
    parts = F.split(field, "[/ ]")
    date = F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"))
    dashed = F.when(field.rlike(_SLASHED), F.concat_ws(" ", date, F.get(parts, F.lit(3)))).otherwise(field)
    # A time of day without seconds has one colon.
    return F.when(dashed.rlike(r"^[^:]*\d:\d{2}$"), F.concat(dashed, F.lit(":00"))).otherwise(dashed)


def write_export(df: DataFrame, path: str, *, encoding: str = LATIN1, missing: str = "") -> None:
    """Write a ledger as CSV files with a header line each.

    A character that the encoding does not have stops the job.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    kept = {c: F.decode(F.encode(F.col(f"`{c}`"), encoding), encoding) for c in texts}
    df.withColumns(kept).write.options(header=True, encoding=encoding, escape='"', nullValue=missing).csv(path)
