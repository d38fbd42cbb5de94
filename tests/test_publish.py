import csv
import json
from pathlib import Path

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from cartlens.config import ConfigError
from cartlens.plans.publish import (
    RunError, load_current, load_run, publish_extract, publish_metrics, publish_reports, run,
)
from cartlens.plans.quality import QualityError
from cartlens.sources.csv_source import (
    SourceError, file_manifest, read_source, read_sources, snapshot_fingerprint, snapshot_label,
    source_manifest,
)
from cartlens.sources import releases
from cartlens.sources.files import create_json
from cartlens.sources.results import ExportError, read_table
from plain import order_facts
from sample import CONFIG, FILES, changed, one_order, records, tidy, write_csv

WINDOW = changed(
    CONFIG, analysis_start="2020-02-01", analysis_end="2020-02-29", observation_end="2020-03-31 23:59:59"
)


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    """One published run: output folder and run."""
    base = tmp_path_factory.mktemp("published")
    directory, output = write_csv(base / "raw", one_order()), base / "out"
    return directory, output, run(spark, str(directory), str(output), WINDOW)


def edit(directory, table, change):
    path = directory / FILES[table]
    path.write_text(change(path.read_text(encoding="utf-8-sig")), encoding="utf-8")


def csv_text(path):
    return "".join(part.read_text() for part in sorted(path.glob("data/part=*/part-*.csv")))


def entries(output):
    return {path.name: path.read_bytes() for path in (output / "log").iterdir() if path.suffix == ".json"}


def test_sources_keep_text_and_line_breaks(spark, tmp_path):
    raw = read_sources(spark, str(write_csv(tmp_path / "raw", one_order())))
    assert raw["orders"].columns[0] == "order_id"
    assert set(dict(raw["items"].dtypes).values()) == {"string"}
    message = raw["reviews"].first()["review_comment_message"]
    assert message == 'two lines\nand a "quote", too'


def test_missing_file_column_and_repeated_header_are_named(spark, tmp_path):
    directory = write_csv(tmp_path / "raw", one_order())
    with pytest.raises(SourceError, match="orders_dataset"):
        read_source(spark, str(tmp_path / "nowhere"), "orders")
    edit(directory, "items", lambda text: text.replace(",price,", ",cost,"))
    with pytest.raises(SourceError, match="price"):
        read_source(spark, str(directory), "items")
    edit(directory, "payments", lambda text: text.replace("payment_type", "order_id,payment_type", 1))
    with pytest.raises(SourceError, match="repeats columns: order_id"):
        read_source(spark, str(directory), "payments")


def test_two_snapshots_in_one_folder_are_refused(spark, tmp_path):
    directory = write_csv(tmp_path / "raw", one_order())
    (directory / "older_orders_dataset.csv").write_bytes((directory / FILES["orders"]).read_bytes())
    with pytest.raises(SourceError, match="several snapshots of orders: older_orders_dataset.csv, shop_orders_dataset.csv"):
        read_source(spark, str(directory), "orders")


def test_extra_and_reordered_columns_are_accepted(spark, tmp_path):
    directory = write_csv(tmp_path / "raw", one_order())
    (directory / FILES["category_translation"]).write_text(
        "note,product_category_name_english,product_category_name\nx,toys,spielzeug\n"
    )
    table = read_source(spark, str(directory), "category_translation")
    assert table.first().asDict() == {
        "note": "x", "product_category_name_english": "toys", "product_category_name": "spielzeug",
    }


@pytest.mark.parametrize("line", ["B2,2\n", "B2,2,p,s,,1,1,1,1\n"])
def test_malformed_rows_fail_even_for_a_count(spark, tmp_path, line):
    directory = write_csv(tmp_path / "raw", one_order())
    edit(directory, "items", lambda text: text + line)
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED|FAILFAST|Malformed"):
        read_source(spark, str(directory), "items").count()


def test_sources_may_be_directories_of_files(spark, tmp_path):
    directory = write_csv(tmp_path / "raw", one_order())
    many = tmp_path / "many"
    many.mkdir()
    header, row = (directory / FILES["items"]).read_text(encoding="utf-8-sig").splitlines()
    for n in range(3):
        (many / f"part{n}.csv").write_text(f"{header}\n{row.replace('B1,1', f'B1,{n}')}\n")
    table = read_source(spark, str(directory), "items", {"items": str(many)})
    assert sorted(r["order_item_id"] for r in table.collect()) == ["0", "1", "2"]


def test_manifest_and_fingerprint(spark, tmp_path):
    directory = write_csv(tmp_path / "raw", one_order())
    files = records(file_manifest(spark, str(directory)), "source")
    assert len(files) == 7 and all(len(row["sha256"]) == 64 for row in files.values())
    label = snapshot_label(file_manifest(spark, str(directory)))
    assert len(label) == 12
    first = snapshot_fingerprint(source_manifest(read_sources(spark, str(directory))))
    assert first == snapshot_fingerprint(source_manifest(read_sources(spark, str(directory))))
    edit(directory, "items", lambda text: text.replace("90.00", "91.00"))
    assert first != snapshot_fingerprint(source_manifest(read_sources(spark, str(directory))))
    # same names and sizes, other content
    assert label != snapshot_label(file_manifest(spark, str(directory)))


def test_run_publishes_and_is_repeatable(spark, tmp_path, published):
    directory, output, done = published
    assert (done.status["status"], done.status["blocking_failures"], done.status["checks"]) == ("passed", 0, 72)
    current = load_current(spark, str(output), WINDOW)
    assert current.path == done.path
    assert len(current.status["exports"]) == 12
    january = csv_text(output / "runs" / done.path.rsplit("/", 1)[-1] / "csv" / "q01_monthly_commerce")
    rows = list(csv.DictReader(january.splitlines()))
    assert [(row["purchase_month"], row["merchandise_value"]) for row in rows] == [("2020-02-01", "90.00")]
    assert not (output / "runs" / done.path.rsplit("/", 1)[-1] / "csv" / "q09_customer_observed_sequence").exists()
    assert current.result("q09_customer_observed_sequence").count() == 1
    assert current.model.orders(["delivery_days"]).first()[0] == pytest.approx(5 + 8 / 24)

    again = run(spark, str(directory), str(output), WINDOW.as_dict())
    assert again.status["exports"] == done.status["exports"]
    assert again.status["source_fingerprint"] == done.status["source_fingerprint"]
    for name in done.status["exports"]:
        assert csv_text(output / "runs" / again.path.rsplit("/", 1)[-1] / "csv" / name) == csv_text(
            output / "runs" / done.path.rsplit("/", 1)[-1] / "csv" / name
        )

    public = csv_text(Path(publish_extract(current, str(tmp_path / "extract"))) / "fact_orders")
    assert "B1" not in public and "NORTH" in public


def test_failed_checks_keep_the_previous_pointer(spark, tmp_path, published):
    directory, output = write_csv(tmp_path / "raw", one_order()), published[1]
    before = entries(output)
    edit(directory, "items", lambda text: text.splitlines()[0] + "\n")
    with pytest.raises(QualityError, match="merchandise"):
        run(spark, str(directory), str(output), WINDOW)
    assert entries(output) == before
    failed = list((output / "runs").glob("*/failed.json"))
    assert len(failed) == 1
    assert "delivered.merchandise_missing" in json.loads(failed[0].read_text())["checks"]
    with pytest.raises(RunError, match="failed"):
        load_run(spark, str(failed[0].parent))


def test_conflicting_key_is_blocked(spark, tmp_path):
    directory = write_csv(tmp_path / "raw", one_order())
    edit(directory, "orders", lambda text: text + text.splitlines()[1].replace("delivered", "canceled") + "\n")
    with pytest.raises(QualityError, match="orders.key_conflicts"):
        run(spark, str(directory), str(tmp_path / "out"), WINDOW)


def test_nothing_is_published_for_bad_input(spark, tmp_path):
    output = tmp_path / "out"
    with pytest.raises(SourceError):
        run(spark, str(tmp_path / "nowhere"), str(output), WINDOW)
    assert not (output / "log").exists()
    with pytest.raises(ConfigError):
        run(spark, str(tmp_path / "nowhere"), str(output), WINDOW.as_dict() | {"analysis_end": "2020-01-01"})
    with pytest.raises(RunError, match="log is empty"):
        load_current(spark, str(output))


def test_log_cannot_lead_out_of_the_folder(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "000000000001.json").write_text(json.dumps({"run_id": "../../elsewhere"}))
    with pytest.raises(RunError, match="invalid entry"):
        load_current(spark, str(tmp_path))


def test_an_older_release_that_ends_later_does_not_replace_a_newer_one(spark, tmp_path):
    older, newer = releases.begin(spark, str(tmp_path)), releases.begin(spark, str(tmp_path))
    assert older.number < newer.number
    releases.finish(spark, newer, {"n": 2})
    releases.finish(spark, older, {"n": 1})
    assert releases.current(spark, str(tmp_path)) == newer.path
    assert len(entries(tmp_path)) == 2


def test_numbers_are_given_once(spark, tmp_path):
    assert create_json(spark, str(tmp_path / "tickets" / "000000000001.json"), {"run_id": "r" + "0" * 32})
    assert not create_json(spark, str(tmp_path / "tickets" / "000000000001.json"), {"run_id": "x"})
    assert json.loads((tmp_path / "tickets" / "000000000001.json").read_text()) == {"run_id": "r" + "0" * 32}
    assert releases.begin(spark, str(tmp_path)).number == 2
    assert not list((tmp_path / "tickets").glob("*.tmp"))


def test_a_release_is_recovered_if_its_writer_dies_before_the_commit(spark, tmp_path, monkeypatch):
    first, second, failed = (releases.begin(spark, str(tmp_path)) for _ in range(3))
    releases.finish(spark, first, {"n": 1})
    monkeypatch.setattr(releases, "_commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        releases.finish(spark, second, {"n": 2})
    monkeypatch.undo()
    releases.fail(spark, failed, {"n": 3})
    releases.begin(spark, str(tmp_path))  # begun, nothing written
    assert releases.current(spark, str(tmp_path)) == first.path
    assert releases.recover(spark, str(tmp_path)) == [second.number]
    assert releases.current(spark, str(tmp_path)) == second.path
    assert releases.recover(spark, str(tmp_path)) == []


def test_reports_and_measures_of_a_run_are_released(spark, tmp_path, published):
    opened = load_current(spark, str(published[1]), WINDOW)
    reports = Path(publish_reports(opened, str(tmp_path / "reports")))
    status = json.loads((reports / "run.json").read_text())
    assert set(status["exports"]) == {
        "overview", "overview_states", "sensitivity", "cohorts", "partial_cohorts", "quality", "profile_rows", "profile_months",
    }
    assert status["source_run"] == opened.path.rsplit("/", 1)[-1]
    rows = list(csv.DictReader(csv_text(reports / "overview").splitlines()))
    assert [(row["delivered_orders"], row["merchandise_value"]) for row in rows] == [("1", "90.00")]
    assert len(list(csv.DictReader(csv_text(reports / "sensitivity").splitlines()))) == 2
    measures = Path(publish_metrics(opened, str(tmp_path / "metrics")))
    rows = list(csv.DictReader(csv_text(measures / "measures_by_context").splitlines()))
    assert [(row["context"], row["gmv"], row["delivered_orders"]) for row in sorted(rows, key=lambda r: r["context"])] == [
        ("MONTH", "90.00", "1"), ("STATE", "90.00", "1"), ("WINDOW", "90.00", "1"),
    ]
    assert releases.current(spark, str(tmp_path / "metrics")) == str(measures)


def test_unapproved_parameters_are_refused(spark, published):
    output = published[1]
    with pytest.raises(RunError, match="parameters"):
        load_current(spark, str(output), CONFIG)


def test_reading_back_validates_shape(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "order_id string, n int")
    df.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ExportError, match="price"):
        read_table(spark, str(tmp_path / "t"), ["order_id", "price"])
    with pytest.raises(ExportError, match="one row per order_id"):
        read_table(spark, str(tmp_path / "t"), ["order_id"], "order_id")


def test_a_whole_market_gives_the_same_facts_when_stored(spark, tmp_path):
    rows = tidy()
    done = run(spark, str(write_csv(tmp_path / "raw", rows)), str(tmp_path / "out"), CONFIG)
    facts = [f for f in order_facts(rows).values() if CONFIG.analysis_start <= f["purchase_date"] <= CONFIG.analysis_end]
    days = [f["delivery_days"] for f in facts if f["delivery_days"] is not None]
    q05 = records(done.result("q05_delivery_duration"), "scope", "purchase_month", "customer_state")
    assert q05["WINDOW", None, None]["p90_delivery_days"] == pytest.approx(np.percentile(days, 90))
    q01 = records(done.result("q01_monthly_commerce"))
    sold = [f["merchandise_value"] for f in facts if f["order_status"] == "delivered"]
    assert sum(row["merchandise_value"] for row in q01) == sum(sold)
    failed = {row["check"] for row in records(done.quality) if not row["passed"]}
    assert done.status["warnings"] == len(failed) > 0
