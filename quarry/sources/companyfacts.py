"""A reader of folders of company-facts JSON: spark.read.format("companyfacts").load(folder), after register(spark).

Small files share a partition, once there are many. Filters on cik leave out whole files by their names (CIK<number>.json, or a folder cik=<number>); filters on taxonomy and concept leave out
what needs no look at its entries. A file that can't be parsed is one row with its error, so a batch goes on and the rest of it is not lost.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "cik long, taxonomy string, concept string, unit string, start string, end string, val double, accn string, form string, filed string, file string, error string"
#: The number of a company in a file's name, or in that of a folder by company.
NAME = re.compile(r"CIK0*(\d+)\.json$|/cik=(\d+)/[^/]*$")
#: Bytes of the files that one task reads, larger files apart.
BYTES = 16 * 1024 * 1024
#: Tasks that files of fewer bytes are dealt among, where there are as many.
TASKS = 64
ENTRY = ("start", "end", "val", "accn", "form", "filed")


@dataclass
class File(InputPartition):
    paths: list[str]


def files(folder: str, suffix: str = ".json") -> list[tuple[str, int]]:
    """Files, each with its bytes, of this suffix under a folder of any file system that Arrow knows; a list of names comes to the driver, as Spark's own readers have it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size or 0) for f in found if f.is_file and f.path.endswith(suffix))


def opened(folder: str, path: str) -> bytes:
    from pyarrow import fs

    system = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    with system.open_input_stream(path) as f:
        return f.read()


class Reader(DataSourceReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality and lists of values of cik, taxonomy and concept are taken; Spark keeps the rest."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("cik",), ("taxonomy",), ("concept",)):
                yield f
            else:
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self) -> list[File]:
        cik, out, size = self.wanted.get("cik"), [], 0
        found = [(p, n) for p, n in files(self.folder, self.suffix) if cik is None or not (m := NAME.search(p)) or int(m[1] or m[2]) in cik]
        most = min(BYTES, sum(n for _, n in found) // TASKS)
        for path, n in found:
            if not out or size + n > most:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [File(p) for p in out] or [File([])]

    def takes(self, name: str, value: object) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def read(self, partition: File) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.rows(path)

    def rows(self, path: str) -> list[tuple]:
        try:
            body = json.loads(opened(self.folder, path))
            cik, taxonomies = int(body["cik"]), body["facts"]
            rows = [
                (cik, taxonomy, concept, unit, *(None if (v := e.get(k)) is None else float(v) if k == "val" else str(v) for k in ENTRY), path, None)
                for taxonomy, concepts in taxonomies.items() if self.takes("cik", cik) and self.takes("taxonomy", taxonomy)
                for concept, about in concepts.items() if self.takes("concept", concept)
                for unit, entries in about.get("units", {}).items()
                for e in entries if e.get("val") is not None and e.get("end") and e.get("accn")
            ]
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            rows = [] if self.wanted else [(*[None] * 10, path, f"{type(e).__name__}: {e}"[:200])]
        return rows


class CompanyFacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "companyfacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("suffix", ".json"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CompanyFacts)
