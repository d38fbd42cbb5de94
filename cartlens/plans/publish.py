"""The full run: sources, staging, model, questions, checks and a gated, versioned publish."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from cartlens.config import AnalysisConfig
from cartlens.plans.analyses import ANALYSES, CUSTOMER_LEVEL, result_order, with_cells
from cartlens.plans.extract import (
    WHITELIST,
    category_groups,
    extract_tables,
    require_public,
    require_reconciled,
)
from cartlens.plans.metrics import (
    ALL_ORDER_METRICS,
    fact_columns,
    item_gmv,
    metrics,
    metrics_by_context,
    reconciliation_contexts,
)
from cartlens.plans.model import (
    ITEM_COLUMNS,
    ORDER_COLUMNS,
    StagedModel,
    StoredModel,
    build_dates,
)
from cartlens.plans.quality import (
    ERROR,
    WARNING,
    QualityError,
    analysis_checks,
    model_checks,
    quality_report,
    require_passed,
    staging_checks,
)
from cartlens.plans.reports import purchase_profile, report_tables, row_profile
from cartlens.plans.staging import stage_table
from cartlens.sources.csv_source import (
    file_manifest,
    read_sources,
    snapshot_fingerprint,
    source_manifest,
)
from cartlens.sources import releases
from cartlens.sources.files import exists, read_json, remove
from cartlens.sources.releases import ReleaseError
from cartlens.sources.results import export_csv, read_table, write_table

PARALLEL_JOBS = 6
DIMENSIONS = ("dim_date", "dim_customer_state", "dim_category")


class RunError(ReleaseError):
    """There is no usable published run."""


@dataclass(frozen=True)
class Run:
    spark: SparkSession
    path: str
    status: dict

    @property
    def config(self) -> AnalysisConfig:
        return AnalysisConfig.from_mapping(self.status["config"])

    @property
    def model(self) -> StoredModel:
        return StoredModel(self.spark, f"{self.path}/model")

    @property
    def quality(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/quality/*")

    def result(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/results/{name}")

    def results(self) -> dict[str, DataFrame]:
        return {name: self.result(name) for name in ANALYSES}


def _root(output: str) -> str:
    return str(output).rstrip("/")


def _write_checks(checks: DataFrame, path: str, stage: str) -> DataFrame:
    """Write the check rows of a stage once; the gate reads the written rows.

    Each check row comes out of a one-row aggregate, so one file holds them all.
    """
    checks.coalesce(1).write.mode("errorifexists").parquet(f"{path}/quality/{stage}")
    return checks.sparkSession.read.parquet(f"{path}/quality/{stage}")


def _together(spark: SparkSession, jobs: Iterable[Callable[[], object]]) -> list:
    """Submit independent jobs at once, so that small ones do not wait for each other."""
    with ThreadPoolExecutor(max_workers=PARALLEL_JOBS) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in started]


def _stored(
    spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]], path: str
) -> dict[str, DataFrame]:
    """Build, write and read back tables: later plans start from files, not from lineage."""

    def store(name, build):
        df = build()
        write_table(df, f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    jobs = [partial(store, name, build) for name, build in tables.items()]
    return dict(zip(tables, _together(spark, jobs)))


def build_model(staged: Mapping[str, DataFrame], config: AnalysisConfig, path: str) -> StoredModel:
    """Write facts and dimensions once. The facts are partitioned by purchase month."""
    lazy = StagedModel(dict(staged))
    facts = {"fact_orders": lazy.orders(), "fact_order_items": lazy.items()}
    members = {"dim_customer_state": lazy.states(), "dim_category": lazy.categories()}
    _together(
        lazy.spark,
        [partial(write_table, df, f"{path}/{n}", "purchase_month") for n, df in facts.items()]
        + [partial(write_table, df, f"{path}/{n}") for n, df in members.items()],
    )
    stored = StoredModel(lazy.spark, path)
    write_table(build_dates(stored.orders(["purchase_date"]), config), f"{path}/dim_date")
    return stored


def run(
    spark: SparkSession,
    raw: Mapping[str, DataFrame] | str,
    output: str,
    config: AnalysisConfig | Mapping,
    locations: Mapping[str, str] | None = None,
) -> Run:
    """Run everything from CSV sources (a directory) or all-text tables, then publish.

    Every run writes below its own folder and is committed under its number only when all
    blocking checks passed, so a failed run leaves the current one in place, and so does an
    older run that ends after a newer one.
    """
    if not isinstance(config, AnalysisConfig):
        config = AnalysisConfig.from_mapping(config)

    def fill(path: str) -> dict:
        return _execute(spark, raw, path, config, locations)

    path, status = _released(spark, output, fill, {"config": config.as_dict()})
    return Run(spark, path, status)


def _released(
    spark: SparkSession, output: str, fill: Callable[[str], dict], known: dict
) -> tuple[str, dict]:
    """Fill the folder of a new release, then commit it; a failure is recorded with its check rows."""
    releases.recover(spark, output)
    ticket = releases.begin(spark, output)
    try:
        status = fill(ticket.path)
    except Exception as error:
        failure = {"status": "failed", "error": type(error).__name__, "message": str(error)}
        releases.fail(spark, ticket, failure | {"checks": getattr(error, "checks", [])} | known)
        raise
    releases.finish(spark, ticket, status)
    return ticket.path, status


def _execute(spark, raw, path, config, locations) -> dict:
    files = None
    if not isinstance(raw, Mapping):
        files = (str(raw), locations)
        raw = read_sources(spark, str(raw), locations, f"{path}/landing")
    sources = {"sources": partial(source_manifest, raw)}
    if files is not None:
        sources["files"] = partial(file_manifest, spark, *files, f"{path}/landing")
    staging = {table: partial(stage_table, df, table) for table, df in raw.items()}
    manifest, staged = _together(
        spark,
        [
            lambda: _stored(spark, sources, f"{path}/manifest")["sources"],
            lambda: _stored(spark, staging, f"{path}/staging"),
        ],
    )
    fingerprint = snapshot_fingerprint(manifest)
    raw_rows = {row["source"]: row["rows"] for row in manifest.select("source", "rows").collect()}

    gates = [_write_checks(staging_checks(dict(raw), staged, raw_rows), path, "staging")]
    require_passed(gates[-1])

    model = build_model(staged, config, f"{path}/model")
    gates.append(_write_checks(model_checks(staged, model), path, "model"))
    require_passed(gates[-1])

    profile = {
        "rows": partial(row_profile, dict(raw), staged, raw_rows),
        "months": partial(purchase_profile, staged),
    }
    questions = with_cells(model, config, f"{path}/landing")
    _, results = _together(
        spark,
        [
            lambda: _stored(spark, profile, f"{path}/profile"),
            lambda: _stored(spark, questions, f"{path}/results"),
        ],
    )
    gates.append(_write_checks(analysis_checks(results, model, config), path, "analyses"))
    require_passed(gates[-1])

    public = {name: require_public(df, name) for name, df in results.items() if name not in CUSTOMER_LEVEL}
    public |= {name: model.dimension(name) for name in DIMENSIONS}
    described = _together(
        spark,
        [
            partial(
                export_csv, df, f"{path}/csv/{name}", result_order(name) if name in results else None,
                f"{path}/landing/{name}",
            )
            for name, df in public.items()
        ],
    )
    exports = dict(zip(public, described))
    remove(spark, f"{path}/landing")

    checks = [row for gate in gates for row in gate.collect()]
    return {
        "status": "passed",
        "config": config.as_dict(),
        "source_fingerprint": fingerprint,
        "blocking_failures": sum(c["severity"] == ERROR and not c["passed"] for c in checks),
        "warnings": sum(c["severity"] == WARNING and not c["passed"] for c in checks),
        "checks": len(checks),
        "exports": exports,
    }


def load_run(spark: SparkSession, path: str, approved: AnalysisConfig | None = None) -> Run:
    """Open a run for downstream use; refuse failed runs and unapproved parameters."""
    path = _root(path)
    if exists(spark, f"{path}/failed.json") or not exists(spark, f"{path}/run.json"):
        raise RunError("the run failed or never finished")
    status = read_json(spark, f"{path}/run.json")
    if status.get("status") != "passed" or status.get("blocking_failures") != 0:
        raise RunError("the run has blocking failures")
    if approved is not None and status.get("config") != approved.as_dict():
        raise RunError("the run was made with other parameters than the approved ones")
    opened = Run(spark, path, status)
    try:
        require_passed(opened.quality)
    except QualityError as error:
        raise RunError(str(error)) from error
    return opened


def load_current(spark: SparkSession, output: str, approved: AnalysisConfig | None = None) -> Run:
    """Open the newest committed run."""
    try:
        path = releases.current(spark, output)
    except ReleaseError as error:
        raise RunError(str(error)) from error
    return load_run(spark, path, approved)


def _published(opened: Run, output: str, tables: Mapping[str, DataFrame], kind: str) -> str:
    """Release public tables as CSV with a manifest; returns their folder."""
    spark = opened.spark
    public = {name: require_public(df, name) for name, df in tables.items()}

    def fill(path: str) -> dict:
        jobs = [partial(export_csv, df, f"{path}/{name}", None, f"{path}/landing/{name}") for name, df in public.items()]
        exports = dict(zip(public, _together(spark, jobs)))
        remove(spark, f"{path}/landing")
        return {
            "status": "passed",
            "kind": kind,
            "source_run": opened.path.rsplit("/", 1)[-1],
            "source_fingerprint": opened.status["source_fingerprint"],
            "config": opened.config.as_dict(),
            "exports": exports,
        }

    return _released(spark, output, fill, {"kind": kind})[0]


def publish_extract(opened: Run, output: str) -> str:
    """Release the anonymised extract after key, privacy and reconciliation gates."""
    model_path = f"{opened.path}/model"
    read_table(opened.spark, f"{model_path}/fact_orders", list(ORDER_COLUMNS), "order_id")
    read_table(opened.spark, f"{model_path}/fact_order_items", list(ITEM_COLUMNS))
    tables = extract_tables(opened.model, opened.config)
    require_reconciled(tables)
    return _published(opened, output, {name: tables[name] for name in WHITELIST}, "extract")


def publish_reports(opened: Run, output: str) -> str:
    """Release the aggregate reports of a run: headline figures, sensitivity, cohorts, data profile and checks."""
    profile = {name: opened.spark.read.parquet(f"{opened.path}/profile/{name}") for name in ("rows", "months")}
    tables = report_tables(opened.results(), opened.config) | {
        "quality": quality_report(opened.quality),
        "profile_rows": profile["rows"],
        "profile_months": profile["months"],
    }
    return _published(opened, output, tables, "reports")


def publish_metrics(opened: Run, output: str) -> str:
    """Release the measures of a run with their reconciliation contexts; refused if both facts disagree."""
    tables = extract_tables(opened.model, opened.config)
    require_reconciled(tables)
    orders = opened.model.orders(fact_columns(ALL_ORDER_METRICS, ["customer_state", "purchase_month", "purchase_date"]), opened.config)
    contexts = reconciliation_contexts(orders, opened.config)
    items = opened.model.items([*WHITELIST["fact_order_items"]], opened.config)
    grouped = items.join(category_groups(items, opened.model.categories()), "category")
    measures = {
        "measures": metrics(orders, [], ALL_ORDER_METRICS),
        "measures_by_month": metrics(orders, ["purchase_month"], ALL_ORDER_METRICS),
        "measures_by_state": metrics(orders, ["customer_state"], ALL_ORDER_METRICS),
        "measures_by_context": metrics_by_context(orders, contexts),
        "item_amount_by_category_group": item_gmv(grouped, ["category_group"]),
    }
    return _published(opened, output, measures, "metrics")
