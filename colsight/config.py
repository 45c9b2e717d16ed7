"""Options of a profiling run and the statistic conventions of each engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """How one engine defines the statistics whose meaning differs between engines."""

    name: str
    population_moments: bool = False  # STDDEV/VARIANCE divide by n instead of n - 1
    null_counts_on_empty: bool = False  # conditional counts are NULL, not 0, on an empty table
    percentile_mode: str = "exact"  # "exact" | "approx" | "upper_median"
    has_enum: bool = False  # enum columns always get top values

    @property
    def has_outliers(self) -> bool:
        return self.percentile_mode != "upper_median"


_DIALECTS = {
    "postgres": Dialect("postgres", has_enum=True),
    "mysql": Dialect(
        "mysql", population_moments=True, null_counts_on_empty=True, percentile_mode="upper_median", has_enum=True
    ),
    "snowflake": Dialect("snowflake"),
    "databricks": Dialect("databricks"),
    "bigquery": Dialect("bigquery", percentile_mode="approx"),
    "redshift": Dialect("redshift", null_counts_on_empty=True),
    "file": Dialect("file"),
}


def dialect(name: str) -> Dialect:
    return _DIALECTS[name]


# Schemas each engine hides by default.
DEFAULT_EXCLUDED_SCHEMAS = {
    "postgres": ("pg_catalog", "information_schema", "pg_toast"),
    "redshift": ("pg_catalog", "information_schema", "pg_toast"),
    "mysql": ("information_schema", "mysql", "performance_schema", "sys"),
    "snowflake": ("INFORMATION_SCHEMA",),
    "databricks": ("information_schema",),
    "bigquery": ("INFORMATION_SCHEMA",),
    "file": (),
}


def _positive(name: str, value: int) -> None:
    if value < 1:
        raise ValueError(f"{name} must be at least 1, got {value}")


@dataclass(frozen=True)
class ProfileConfig:
    """Which parts of a profile to compute, and their limits."""

    dialect: Dialect = _DIALECTS["postgres"]
    include_schemas: tuple[str, ...] | None = None
    exclude_schemas: tuple[str, ...] | None = None  # None: the engine's default list
    include_tables: tuple[str, ...] | None = None
    exclude_tables: tuple[str, ...] = ()
    sample_size: int = 10
    sample_seed: int = 42
    include_sample_data: bool = True
    include_row_counts: bool = True
    include_indexes: bool = True
    include_relationships: bool = True
    include_data_freshness: bool = True
    include_column_stats: bool = True
    top_values_limit: int = 10
    top_values_cardinality_threshold: int = 100
    max_concurrent_tables: int = 3
    timeout_seconds: float | None = 1000.0  # of a whole run; None: no limit
    columns_per_job: int = 200  # tables are profiled together up to so many columns
    bytes_per_job: int = 1 << 30  # and up to so many estimated bytes; a larger table is a job of its own
    concurrent_bytes: int = 1 << 44  # estimated bytes of the tables that are profiled at the same time
    sensitivity_batch_size: int = 20
    approx_accuracy: int = 10_000
    aggregates_per_scan: int = 40
    rank_sketch: int = 4096  # size of the sketch that encloses ranks; each enclosed part holds about 1/300 of a column

    def __post_init__(self) -> None:
        _positive("sample_size", self.sample_size)
        _positive("top_values_limit", self.top_values_limit)
        _positive("top_values_cardinality_threshold", self.top_values_cardinality_threshold)
        _positive("max_concurrent_tables", self.max_concurrent_tables)
        _positive("sensitivity_batch_size", self.sensitivity_batch_size)
        _positive("columns_per_job", self.columns_per_job)
        if self.timeout_seconds is not None and self.timeout_seconds <= 0:
            raise ValueError(f"timeout_seconds must be above 0, got {self.timeout_seconds}")
        if not 8 <= self.rank_sketch <= 65_535:
            raise ValueError(f"rank_sketch must be between 8 and 65535, got {self.rank_sketch}")

    @property
    def excluded_schemas(self) -> tuple[str, ...]:
        if self.exclude_schemas is not None:
            return self.exclude_schemas
        return DEFAULT_EXCLUDED_SCHEMAS[self.dialect.name]

    def selects(self, schema: str, table: str) -> bool:
        """Whether the include and exclude lists let a table take part; an exclude list wins."""
        return (
            (self.include_schemas is None or schema in self.include_schemas)
            and schema not in self.excluded_schemas
            and (self.include_tables is None or table in self.include_tables)
            and table not in self.exclude_tables
        )
