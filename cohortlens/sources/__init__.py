from cohortlens.sources.layout import convert_tables, save_bucketed, save_clustered
from cohortlens.sources.sampling import coherent_sample, in_sample, orphans
from cohortlens.sources.schemas import SCHEMAS
from cohortlens.sources.tables import item_values, load_tables, preview, save_table

__all__ = [
    "SCHEMAS",
    "coherent_sample",
    "convert_tables",
    "in_sample",
    "item_values",
    "load_tables",
    "orphans",
    "preview",
    "save_bucketed",
    "save_clustered",
    "save_table",
]
