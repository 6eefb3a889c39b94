"""Settings with validation; environment variables ``TIDEWELL_<FIELD>`` override given values, those override defaults."""

from __future__ import annotations

import os
import re
import shutil
from dataclasses import dataclass, fields

#: Fixed values.
REMOTE_MODULES = ("Leads", "Contacts", "Accounts", "Deals", "Tasks", "Events", "Calls", "Products", "Quotes", "Sales_Orders", "Purchase_Orders", "Invoices", "Campaigns", "Suppliers")


def cast(value: str, like: object):
    """An environment value as the type of the default."""
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, int):
        return int(value)
    if isinstance(like, float):
        return float(value)
    if isinstance(like, tuple):
        return tuple(x.strip() for x in value.split(",") if x.strip())
    return value


@dataclass
class Settings:
    watch_dir: str = ""
    chunk_size: int = 1000
    match_threshold: float = 80.0
    auto_create: bool = True
    approval_required: bool = True
    max_jobs: int = 5
    poll_minutes: int = 15
    keep_days: int = 30
    max_file_bytes: int = 0  # 0: any size
    suffixes: tuple = (".csv", ".xlsx", ".xls")
    # Ways of the former tool that its users may rely on; by default a value that doesn't fit its type fails its row.
    int_strip_point: bool = False
    nonnumeric_as_zero: bool = False
    hash_with_row_number: bool = True
    max_rows_per_file: int = 0  # 0: all
    buckets: int = 64  # parts of a table of records, by the hash of the name; fixed once there are records
    check_as_string: bool = False
    type_by_name: bool = True

    def __post_init__(self):
        if errors := self.errors():
            raise ValueError("; ".join(errors))

    def errors(self) -> list[str]:
        out = []
        if not 100 <= self.chunk_size <= 10_000:
            out.append("chunk_size is from 100 to 10000")
        if not 50 <= self.match_threshold <= 95:
            out.append("match_threshold is from 50 to 95")
        if not 1 <= self.max_jobs <= 20:
            out.append("max_jobs is from 1 to 20")
        if self.watch_dir and not re.match(r"^(/|[a-z0-9]+://?)", self.watch_dir):
            out.append("watch_dir is an absolute path")
        return out

    @classmethod
    def load(cls, given: dict | None = None, environment: dict | None = None) -> Settings:
        env = os.environ if environment is None else environment
        values = dict(given or {})
        for f in fields(cls):
            if (x := env.get(f"TIDEWELL_{f.name.upper()}")) is not None:
                values[f.name] = cast(x, f.default)
        return cls(**values)


@dataclass
class RemoteModule:
    """A module of a remote service that is imported into a target."""

    module: str
    target: str
    enabled: bool = True
    direction: str = "import"

    def problems(self, known_targets: list[str]) -> tuple[list[str], list[str]]:
        """(errors, warnings)"""
        errors = ["an enabled module has a name"] if self.enabled and not self.module else []
        if self.target not in known_targets:
            errors.append(f"target {self.target} doesn't exist")
        return errors, [] if self.module in REMOTE_MODULES else [f"{self.module} isn't a usual module"]


def preflight(path: str, least_disk: int = 5 << 30, least_memory: int = 1 << 30) -> list[str]:
    """What the driver's machine lacks."""
    out = []
    if shutil.disk_usage(path).free < least_disk:
        out.append("less than 5 GB of disk is free")
    if os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") < least_memory:
        out.append("the machine has less than 1 GB of memory")
    return out


def is_url(x: str) -> bool:
    return re.match(r"^https?://[^\s/$.?#].[^\s]*$", x) is not None
