"""Numbered releases below a folder: what is begun, written and committed, and which one is current.

`tickets/` has one small file for each release that began, `runs/` its content and `log/` one file for each that was
committed, both named by the ticket's number. Files are created only if absent and never replaced. The current release
is the committed one with the highest number, so one that began earlier and ends later does not replace a newer one.
A release that was written whole but not committed, because its writer died in between, is committed by `recover`.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from cartlens.sources.files import create_json, exists, names, read_json, write_json

RUN_ID = re.compile(r"r[0-9a-f]{32}")
_NUMBER = re.compile(r"[0-9]{12}\.json")


class ReleaseError(RuntimeError):
    """There is no usable release."""


@dataclass(frozen=True)
class Ticket:
    root: str
    number: int
    run_id: str

    @property
    def path(self) -> str:
        return f"{self.root}/runs/{self.run_id}"


def _numbered(number: int) -> str:
    return f"{number:012d}.json"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return [int(name[:12]) for name in names(spark, folder) if _NUMBER.fullmatch(name)]


def begin(spark: SparkSession, root: str) -> Ticket:
    """Take the next number; writers that begin together get different ones."""
    root = str(root).rstrip("/")
    run_id = "r" + uuid.uuid4().hex
    number = max(_numbers(spark, f"{root}/tickets"), default=0) + 1
    while not create_json(spark, f"{root}/tickets/{_numbered(number)}", {"run_id": run_id}):
        number += 1
    return Ticket(root, number, run_id)


def finish(spark: SparkSession, ticket: Ticket, status: dict) -> None:
    """Mark the release as written whole, then commit it."""
    write_json(spark, f"{ticket.path}/run.json", status)
    _commit(spark, ticket.root, ticket.number, ticket.run_id)


def fail(spark: SparkSession, ticket: Ticket, failure: dict) -> None:
    write_json(spark, f"{ticket.path}/failed.json", failure)


def _commit(spark: SparkSession, root: str, number: int, run_id: str) -> None:
    create_json(spark, f"{root}/log/{_numbered(number)}", {"run_id": run_id})


def recover(spark: SparkSession, root: str) -> list[int]:
    """Commit the releases that were written whole but not committed; returns their numbers.

    Only those newer than the current one can still matter.
    """
    root = str(root).rstrip("/")
    newest = max(_numbers(spark, f"{root}/log"), default=0)
    found = []
    for number in _numbers(spark, f"{root}/tickets"):
        if number <= newest:
            continue
        run_id = _run_id(spark, f"{root}/tickets/{_numbered(number)}")
        if exists(spark, f"{root}/runs/{run_id}/run.json") and not exists(spark, f"{root}/runs/{run_id}/failed.json"):
            _commit(spark, root, number, run_id)
            found.append(number)
    return found


def current(spark: SparkSession, root: str) -> str:
    """Folder of the current release. The name in the log is validated, so it cannot lead elsewhere."""
    root = str(root).rstrip("/")
    committed = _numbers(spark, f"{root}/log")
    if not committed:
        raise ReleaseError("nothing was published yet: the log is empty")
    return f"{root}/runs/{_run_id(spark, f'{root}/log/{_numbered(max(committed))}')}"


def _run_id(spark: SparkSession, path: str) -> str:
    run_id = read_json(spark, path).get("run_id")
    if not isinstance(run_id, str) or RUN_ID.fullmatch(run_id) is None:
        raise ReleaseError("invalid entry in the log")
    return run_id
