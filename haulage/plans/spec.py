"""What one load is told: where rows come from, where they go, and how."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from haulage.functions.types import ValueRules

MODES = ("overwrite", "append")


@dataclass(frozen=True)
class LoadSpec:
    """One table load.

    ``path`` reads Parquet files; otherwise ``connection`` holds the JDBC options
    (``url``, ``user``, ``password``, ``driver``) of the source database.
    """

    table_name: str
    schema_name: str = "public"
    namespace: str = "default"
    target_name: str | None = None
    bucket: str | None = None
    prefix: str = "warehouse"
    mode: str = "overwrite"
    batch_size: int = 10_000
    connection: Mapping[str, str] = field(default_factory=dict)
    path: str | None = None
    depends_on: tuple[str, ...] = ()
    partition_column: str | None = None
    num_partitions: int = 1
    cluster_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    z_order_by: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    column_types: Mapping[str, str] = field(default_factory=dict)
    rules: ValueRules = ValueRules()

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if self.num_partitions < 1:
            raise ValueError("num_partitions must be at least 1")
        if self.z_order_by and (self.cluster_by or self.partition_by):
            raise ValueError("rows are laid out by z_order_by or by cluster_by and partition_by, not both")
        if self.num_partitions > 1 and self.path is None and not self.partition_column:
            raise ValueError("more than one JDBC partition needs partition_column")

    @property
    def target(self) -> str:
        return f"{self.namespace}.{self.target_name or self.table_name}"

    @property
    def warehouse(self) -> str | None:
        """Root of the target warehouse in object storage, when a bucket is named."""
        return f"s3a://{self.bucket}/{self.prefix.strip('/')}" if self.bucket else None


# What existing step settings call the fields of a spec.
SETTING_NAMES = {
    "iceberg_namespace": "namespace",
    "iceberg_table_name": "target_name",
    "s3_bucket": "bucket",
    "s3_prefix": "prefix",
    "postgres_conn_id": "connection",
}


def specs_from_steps(
    steps: Mapping[str, Mapping],
    connections: Mapping[str, Mapping[str, str]] | None = None,
    ignore: Collection[str] = (),
) -> dict[str, LoadSpec]:
    """Load specs from a mapping of step id to flat settings, as a config file holds them.

    A connection given by name is looked up in ``connections``, which holds its
    JDBC options. Settings meant for other programs are named in ``ignore``.
    """
    specs = {}
    for step, settings in steps.items():
        known = {SETTING_NAMES.get(k, k): v for k, v in settings.items() if k not in ignore}
        known["depends_on"] = tuple(known.get("depends_on", ()))
        if isinstance(known.get("connection"), str):
            named = known["connection"]
            if named not in (connections or {}):
                raise ValueError(f"step {step}: unknown connection {named!r}")
            known["connection"] = connections[named]
        unknown = set(known) - set(LoadSpec.__dataclass_fields__)
        if unknown:
            raise ValueError(f"step {step}: unknown settings {sorted(unknown)}")
        specs[step] = LoadSpec(**known)
    for step, spec in specs.items():
        missing = set(spec.depends_on) - set(specs)
        if missing:
            raise ValueError(f"step {step} depends on unknown steps {sorted(missing)}")
    return specs
