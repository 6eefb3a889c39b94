"""A paged REST service as a Spark data source.

``spark.read.format("paged_rest").option("module", ...)``: pages are read until
the service says there are no more; a page that is refused once (401) is asked
for again after new credentials.  ``modified_since`` limits a read; a stream
keeps it as its offset.  The transport is a class named by the option
``transport`` ("package.module:Class") with ``get(url, params, headers)``, which
returns (status, document), and ``refresh()``, which returns headers.
"""

from __future__ import annotations

import importlib
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

PAGE_SIZE = 200


class HttpTransport:
    """Plain HTTP with a refresh token; options: token_url, client_id, client_secret, refresh_token."""

    def __init__(self, options: dict):
        self.options = options

    def get(self, url: str, params: dict, headers: dict) -> tuple[int, dict]:
        request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers=headers)
        try:
            with urllib.request.urlopen(request, timeout=30) as answer:
                body = answer.read()
                return answer.status, json.loads(body) if body else {}
        except urllib.error.HTTPError as e:
            return e.code, {}

    def refresh(self) -> dict:
        fields = {k: self.options.get(k, "") for k in ("client_id", "client_secret", "refresh_token")} | {"grant_type": "refresh_token"}
        request = urllib.request.Request(self.options["token_url"], data=urllib.parse.urlencode(fields).encode())
        with urllib.request.urlopen(request, timeout=30) as answer:
            return {"Authorization": f"Bearer {json.loads(answer.read())['access_token']}"}


class ListTransport:
    """Serves the records of the option ``documents`` (JSON: module to records), for tests and trials; asks for credentials once."""

    def __init__(self, options: dict):
        self.documents, self.signed = json.loads(options["documents"]), False

    def get(self, url: str, params: dict, headers: dict) -> tuple[int, dict]:
        module = url.rsplit("/", 1)[-1]
        if not self.signed:
            return 401, {}
        if module == "modules":
            return 200, {"modules": [{"api_name": m} for m in self.documents]}
        since = params.get("modified_since") or ""
        records = [r for r in self.documents.get(module, []) if not since or str(r.get("modified_time", "")) >= since]
        if not records:
            return 204, {}
        at, n = (params["page"] - 1) * params["per_page"], params["per_page"]
        return 200, {"data": records[at : at + n], "info": {"more_records": at + n < len(records)}}

    def refresh(self) -> dict:
        self.signed = True
        return {}


def modules(options: dict) -> list[str]:
    """The names of the service's modules."""
    client = transport(options)
    url = f"{options.get('url', '').rstrip('/')}/settings/modules"
    status, document = client.get(url, {}, {})
    if status == 401:
        status, document = client.get(url, {}, client.refresh())
    if status != 200:
        raise RuntimeError(f"network: {url} answered {status}")
    return [m["api_name"] for m in document.get("modules", [])]


def transport(options: dict):
    name = options.get("transport")
    if not name:
        return HttpTransport(options)
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)(options)


def pages(options: dict, modified_since: str | None = None) -> Iterator[list[dict]]:
    """The records of each page."""
    client, headers, page = transport(options), {}, 1
    url = f"{options.get('url', '').rstrip('/')}/{options['module']}"
    while True:
        params = {"page": page, "per_page": int(options.get("page_size", PAGE_SIZE))} | ({"modified_since": modified_since} if modified_since else {})
        status, document = client.get(url, params, headers)
        if status == 401:
            headers = client.refresh()
            status, document = client.get(url, params, headers)
        if status == 204:
            return
        if status != 200:
            raise RuntimeError(f"network: {url} answered {status}")
        yield document.get("data", [])
        if not document.get("info", {}).get("more_records"):
            return
        page += 1


def _rows(records: list[dict], schema: StructType) -> Iterator[tuple]:
    for r in records:
        yield tuple(None if (v := r.get(f.name)) is None else v if isinstance(v, str) else json.dumps(v) if isinstance(v, dict | list) else str(v) for f in schema)


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return self.options.get("schema", "id string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedRestReader(dict(self.options), schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PagedRestStream(dict(self.options), schema)


class PagedRestReader(DataSourceReader):
    """One partition for each module (comma-separated); the pages of a module come one after another."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(m.strip()) for m in self.options["module"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for records in pages(self.options | {"module": partition.value}, self.options.get("modified_since")):
            yield from _rows(records, self.schema)


class PagedRestStream(SimpleDataSourceStreamReader):
    """Incremental reads; the offset is the latest value of the option ``cursor``'s field."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def initialOffset(self) -> dict:
        return {"since": self.options.get("modified_since", "")}

    def _after(self, since: str) -> list[dict]:
        field = self.options.get("cursor", "modified_time")
        return [r for p in pages(self.options, since or None) for r in p if not since or str(r.get(field, "")) > since]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        records = self._after(start["since"])
        field = self.options.get("cursor", "modified_time")
        return iter(list(_rows(records, self.schema))), {"since": max([start["since"], *(str(r.get(field, "")) for r in records)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        field = self.options.get("cursor", "modified_time")
        return iter(list(_rows([r for r in self._after(start["since"]) if str(r.get(field, "")) <= end["since"]], self.schema)))
