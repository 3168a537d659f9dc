from cohortlens.operators.cohort import (
    build_cohort,
    demographics_of,
    label_prevalence,
    mortality_labels,
)
from cohortlens.operators.counts import value_counts, with_dense_rank
from cohortlens.operators.distributions import (
    box_stats,
    density_2d,
    describe_numeric,
    histogram_auto,
    histogram_fixed,
    quantiles,
)
from cohortlens.operators.labs import abnormal_by_bucket, abnormal_overall
from cohortlens.operators.ordering import (
    audit_order,
    delta_summary,
    negative_deltas,
    order_deltas,
    order_flags,
)
from cohortlens.operators.relations import (
    exclude_by,
    keep_by,
    latest_per_key,
    lookup_with_default,
    not_in,
    sample_rows,
)
from cohortlens.operators.sketches import (
    distinct_error,
    distinct_estimates,
    distinct_sketch,
    merge_distinct_sketches,
    merge_quantile_sketches,
    new_values,
    quantile_ranks,
    quantile_sketch,
    rank_error,
    sketch_quantiles,
)
from cohortlens.operators.states import (
    merge_counts,
    merge_version_states,
    save_batch,
    saved_batches,
    version_state,
    version_stats_of,
)
from cohortlens.operators.status import (
    classify_status,
    merge_timeline_states,
    status_per_admission,
    status_timeline,
    timeline_of,
    timeline_state,
)
from cohortlens.operators.stays import stay_detail, stays_with_admission
from cohortlens.operators.survival import kaplan_meier
from cohortlens.operators.titles import titles_in_chunks, titles_per_group
from cohortlens.operators.versions import (
    size_summary,
    version_by_category,
    version_distribution,
    version_sizes,
    version_stats,
    version_summary,
)
from cohortlens.operators.vitals import summarise_vitals, vital_measurements, vital_values

__all__ = [
    "abnormal_by_bucket",
    "abnormal_overall",
    "audit_order",
    "box_stats",
    "build_cohort",
    "classify_status",
    "delta_summary",
    "demographics_of",
    "density_2d",
    "describe_numeric",
    "distinct_error",
    "distinct_estimates",
    "distinct_sketch",
    "exclude_by",
    "histogram_auto",
    "histogram_fixed",
    "kaplan_meier",
    "keep_by",
    "label_prevalence",
    "latest_per_key",
    "lookup_with_default",
    "merge_counts",
    "merge_distinct_sketches",
    "merge_quantile_sketches",
    "merge_timeline_states",
    "merge_version_states",
    "mortality_labels",
    "negative_deltas",
    "new_values",
    "not_in",
    "order_deltas",
    "order_flags",
    "quantile_ranks",
    "quantile_sketch",
    "quantiles",
    "rank_error",
    "sample_rows",
    "save_batch",
    "saved_batches",
    "size_summary",
    "sketch_quantiles",
    "status_per_admission",
    "status_timeline",
    "stay_detail",
    "stays_with_admission",
    "summarise_vitals",
    "timeline_of",
    "timeline_state",
    "titles_in_chunks",
    "titles_per_group",
    "value_counts",
    "version_by_category",
    "version_distribution",
    "version_sizes",
    "version_state",
    "version_stats",
    "version_stats_of",
    "version_summary",
    "vital_measurements",
    "vital_values",
    "with_dense_rank",
]
