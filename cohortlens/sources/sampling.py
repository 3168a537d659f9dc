"""A development sample whose tables still fit together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys by which a row hangs on its parent, nearest parent first, and the table
# that holds the parent. A row hangs on the first of its keys that is not null.
PARENTS: dict[str, tuple[tuple[str, str], ...]] = {
    "patients": (),
    "admissions": (("subject_id", "patients"),),
    "icustays": (("hadm_id", "admissions"),),
    "chartevents": (("icustay_id", "icustays"), ("hadm_id", "admissions"), ("subject_id", "patients")),
    "labevents": (("hadm_id", "admissions"), ("subject_id", "patients")),
    "noteevents": (("hadm_id", "admissions"), ("subject_id", "patients")),
    "diagnoses_icd": (("hadm_id", "admissions"),),
}
# Tables that describe codes, not patients, stay whole.
WHOLE = ("d_icd_diagnoses",)


def in_sample(key: Column, fraction: float, seed: int = 0) -> Column:
    """Whether a key belongs to a sample: the first 32 bits of its seeded MD5 lie below the fraction.

    It depends on nothing but the key and the seed, so every table, run and engine
    picks the same keys, and a larger fraction only adds to a smaller one.
    """
    ticket = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return key.isNotNull() & (ticket < F.lit(ticket_bound(fraction)))


def ticket_bound(fraction: float) -> str:
    """The bound of a fraction among eight hexadecimal digits; 'g' lies beyond them all."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction lies between 0 and 1")
    return "g" if fraction == 1 else f"{int(fraction * 2**32):08x}"


def coherent_sample(
    tables: Mapping[str, DataFrame], fraction: float, seed: int = 0
) -> dict[str, DataFrame]:
    """The given tables, cut to a seeded share of the patients and to what hangs on them.

    A row is kept if its parent is, so joins between sampled tables find what they
    find between whole ones: every kept row has its parent, and every row of a kept
    parent is kept. Rows without any of their keys, and rows whose parent does not
    exist, hang on nobody and are left out. Keys may repeat. Tables named neither in
    :data:`PARENTS` nor :data:`WHOLE` are refused.

    A parent that is missing from ``tables`` must be given for its children to be cut,
    so pass all tables above the ones you want. Each table is read once, and only the
    keys of its parents' samples meet it, in one semi join whatever the number of its
    keys.
    """
    sampled: dict[str, DataFrame] = {}

    def cut(name: str) -> DataFrame:
        if name not in sampled:
            if name in WHOLE:
                sampled[name] = tables[name]
            elif name not in PARENTS:
                raise ValueError(f"nothing is known about the parents of {name}")
            elif not PARENTS[name]:
                sampled[name] = tables[name].filter(in_sample(F.col("subject_id"), fraction, seed))
            else:
                sampled[name] = _hanging_on(tables[name], name)
        return sampled[name]

    def _hanging_on(df: DataFrame, name: str) -> DataFrame:
        links = PARENTS[name]
        level, key = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (column, _) in reversed(list(enumerate(links))):
            level = F.when(F.col(column).isNotNull(), F.lit(i)).otherwise(level)
            key = F.coalesce(F.col(column), key)
        kept = None
        for i, (column, parent) in enumerate(links):
            own = cut(parent).select(F.lit(i).alias("_level"), F.col(column).alias("_parent"))
            kept = own if kept is None else kept.unionByName(own)
        marked = df.withColumns({"_level": level, "_parent": key})
        return marked.join(kept.distinct(), ["_level", "_parent"], "left_semi").select(*df.columns)

    return {name: cut(name) for name in tables}


def orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_orphans): rows, and those without a parent among the given tables."""
    found = None
    for name, df in tables.items():
        links = PARENTS.get(name, ())
        if links:
            whole = coherent_sample({n: tables[n] for n in with_parents(name)}, 1.0)[name]
            counts = df.agg(F.count(F.lit(1)).alias("n_rows"))
            fit = whole.select(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("n"))
            row = counts.withColumn("n_orphans", F.col("n_rows") - fit.scalar())
        else:
            row = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_orphans", F.lit(0).cast("long"))
        row = row.select(F.lit(name).alias("table"), "n_rows", "n_orphans")
        found = row if found is None else found.unionByName(row)
    return found


def with_parents(name: str) -> list[str]:
    """A table and all those above it."""
    needed = [name]
    for known in needed:
        needed += [parent for _, parent in PARENTS.get(known, ()) if parent not in needed]
    return needed
