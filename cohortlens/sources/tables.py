"""Reading the clinical tables, and saving and querying derived ones."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.sampling import coherent_sample, with_parents
from cohortlens.sources.schemas import SCHEMAS

# Tables with a column of free text, which may hold line breaks.
FREE_TEXT = ("noteevents",)


def load_tables(
    spark: SparkSession,
    root: str,
    fmt: str = "parquet",
    tables: Iterable[str] | None = None,
    options: Mapping[str, str] | None = None,
    sample: float | None = None,
    seed: int = 0,
    bad_values: str = "null",
    schema: str | None = None,
    table_options: Mapping[str, Mapping[str, str]] | None = None,
    sample_by: str = "row",
) -> dict[str, DataFrame]:
    """Clinical tables by name, read lazily with their declared schemas.

    ``root`` is the folder (or, for ``fmt="jdbc"``, the connection URL) and
    ``tables`` the subset wanted. CSV files carry upper- or lower-case file
    names and headers: pass ``options={"extension": ".csv.gz", "upper": "true"}``
    to point at ``ADMISSIONS.csv.gz``. ``sample`` keeps, for development, that
    fraction of the rows of every table or, with ``sample_by="patient"``, of the
    patients and all that hangs on them (:func:`coherent_sample`); the tables above
    the wanted ones are then read too.

    CSV notes may run over several lines, so files of :data:`FREE_TEXT` tables are
    read with ``multiLine`` unless ``options`` says otherwise. Spark cannot split
    such files: convert them to Parquet once. A cell that does not fit its type
    becomes null, or, with ``bad_values="fail"``, stops the job; :func:`unreadable_cells`
    counts them. For JDBC, ``schema`` names the tables' schema, and ``table_options``
    gives options by table, such as the partitioning of a large one.
    """
    if bad_values not in ("null", "fail"):
        raise ValueError("bad_values must be 'null' or 'fail'")
    if sample_by not in ("row", "patient"):
        raise ValueError("sample_by must be 'row' or 'patient'")
    if sample is not None and sample_by == "patient":
        wanted = list(SCHEMAS if tables is None else tables)
        needed = dict.fromkeys(parent for name in wanted for parent in with_parents(name))
        whole = load_tables(
            spark, root, fmt, needed, options, None, seed, bad_values, schema, table_options
        )
        cut = coherent_sample(whole, sample, seed)
        return {name: cut[name] for name in wanted}
    options = dict(options or {})
    extension = options.pop("extension", f".{fmt}")
    upper = options.pop("upper", "false").lower() == "true"
    loaded = {}
    for name in SCHEMAS if tables is None else tables:
        columns = SCHEMAS[name]
        reader = spark.read.format(fmt)
        own = {**options, **(table_options or {}).get(name, {})}
        stored = name.upper() if upper else name
        if fmt == "jdbc":
            df = reader.options(**jdbc_options(root, stored, schema, own)).load()
            df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in columns])
        elif fmt == "csv":
            # Files may hold more columns than the schema names, so columns are
            # found by header name and cast, never by position.
            df = reader.options(**csv_options(name, own)).load(f"{root}/{stored}{extension}")
            kind = "cast" if bad_values == "fail" else "try_cast"
            df = df.select(
                *[getattr(df[f.name], kind)(f.dataType).alias(f.name) for f in columns]
            )
        else:
            df = reader.options(**own).schema(columns).load(f"{root}/{stored}{extension}")
        loaded[name] = df.sample(fraction=sample, seed=seed) if sample is not None else df
    return loaded


def csv_options(name: str, own: Mapping[str, str] = {}) -> dict[str, str]:  # noqa: B006
    """Reader options of a CSV table; ``own`` decides where it says something."""
    several_lines = "true" if name in FREE_TEXT else "false"
    return {"header": "true", "escape": '"', "multiLine": several_lines, **own}


def jdbc_options(
    url: str, table: str, schema: str | None = None, own: Mapping[str, str] = {}  # noqa: B006
) -> dict[str, str]:
    """Reader options of a database table; its timestamps carry no zone, as in the schemas."""
    named = f"{schema}.{table}" if schema else table
    return {"url": url, "dbtable": named, "preferTimestampNTZ": "true", **own}


def unreadable_cells(texts: DataFrame, name: str) -> DataFrame:
    """(table, column, n): cells of ``texts`` that hold something, but not a value of the column's type.

    ``texts`` has the columns of table ``name`` as strings.
    """
    columns = SCHEMAS[name]
    bad = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
        for f in columns
    ]
    counts = texts.agg(*[b.alias(f.name) for b, f in zip(bad, columns)])
    rows = [F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("n")) for f in columns]
    return counts.select(F.lit(name).alias("table"), F.inline(F.array(*rows)))


def save_table(
    df: DataFrame, name: str, mode: str = "overwrite", temp: bool = True
) -> DataFrame:
    """Replace a derived table, and read it back.

    A temporary view lasts as long as the session and stays lazy; ``temp=False``
    writes a catalogue table, worthwhile when several jobs read it.
    """
    if temp:
        df.createOrReplaceTempView(name)
    else:
        df.write.mode(mode).saveAsTable(name)
    return df.sparkSession.table(name)


def item_values(
    events: DataFrame, itemid: int, lo: float, hi: float, value: str = "valuenum"
) -> DataFrame:
    """Values of one item in the open range ``(lo, hi)``, as a bound query."""
    return events.sparkSession.sql(
        f"SELECT {value} AS value FROM {{events}}"
        f" WHERE itemid = :itemid AND {value} > :lo AND {value} < :hi",
        args={"itemid": itemid, "lo": lo, "hi": hi},
        events=events,
    )


def preview(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    """First ``n`` rows in a stated order, so the answer is the same every time."""
    return df.orderBy(*order_by).limit(n)
