"""A table of files: each row (name, content, ...) becomes one file of a folder, and the folder's signed manifest comes last.

Tasks write under names of their own in a staging folder. When all have finished, the driver moves the files to their
names and writes the manifest, so a folder either has a manifest that lists all of it or none. Of a run that fails nothing
stays, unless it may be resumed: then the files of the tasks that finished (each leaves a note of them, so a driver that is
lost changes nothing) are moved and listed in a ledger under the run's identity (its inputs and configuration), pending()
leaves them out of the next run, and a run of another identity, or a folder with files that neither run knows, is refused.
One run at a time writes to a folder.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import pairwise

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.scalar import canonical_json, signed, verify

MANIFEST, LEDGER, STAGING, NOTE = "manifest.json", "ledger.json", ".staging", "finished.json"
#: Bytes that a digest takes at a time.
BLOCK = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it of a plain path or a URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_below(path: str) -> list[tuple[str, int]]:
    """(path from the folder on, bytes) of all files, hidden ones left out; a file alone is listed by its name."""
    there, at = opened(path)
    at = at.rstrip("/")
    if there.get_file_info(at).type == fs.FileType.File:
        return [(posixpath.basename(at), there.get_file_info(at).size)]
    found = there.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    out = [(i.path[len(at) :].lstrip("/"), i.size) for i in found if i.type == fs.FileType.File]
    return sorted((p, n) for p, n in out if not any(x.startswith(".") for x in p.split("/")))


def _text(there: fs.FileSystem, at: str) -> dict | None:
    if there.get_file_info(at).type != fs.FileType.File:
        return None
    with there.open_input_stream(at) as f:
        return json.loads(f.read())


def read_manifest(path: str, name: str = MANIFEST) -> dict | None:
    """A folder's verified manifest (or ledger); None where it has none."""
    there, at = opened(path)
    found = _text(there, f"{at.rstrip('/')}/{name}")
    if found is not None:
        verify(found)
    return found


def _put(there: fs.FileSystem, at: str, content: bytes) -> None:
    own = f"{posixpath.dirname(at)}/.{posixpath.basename(at)}.{uuid.uuid4().hex}"
    with there.open_output_stream(own) as f:
        f.write(content)
    there.move(own, at)


def identity_of(**what) -> str:
    """The hash of a run's inputs and configuration."""
    return hashlib.sha256(canonical_json(what)).hexdigest()


def safe(name: str | None) -> bool:
    return bool(name) and not re.search(r"(^|/)(\.|$)|\\|^/|^[A-Za-z]:|//", name) and name not in (MANIFEST, LEDGER)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, dict]] = field(default_factory=list)  # where it is staged, its record


class StagedWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.identity = options["path"].rstrip("/"), options.get("identity", "")
        self.resume, self.force = (options.get(k, "false").lower() == "true" for k in ("resume", "force"))
        self.meta = json.loads(options.get("meta", "{}"))
        if self.resume and self.force:
            raise ValueError("resume and force exclude each other")
        if not {"name", "content"} <= set(columns):
            raise ValueError("columns name and content are needed")
        self.staging = f"{opened(self.path)[1]}/{STAGING}-{uuid.uuid4().hex}"
        self.done: list[dict] = []
        have = {p for p, _ in files_below(self.path)}
        if self.resume and MANIFEST not in have:
            adopt(self.path, self.identity)
            have = {p for p, _ in files_below(self.path)}
        if have and not self.force:
            ledger = read_manifest(self.path, LEDGER)
            if not self.resume:
                raise FileExistsError(f"{self.path} isn't empty")
            if MANIFEST in have:
                raise FileExistsError(f"{self.path} is complete")
            unknown = sorted(have - {LEDGER} - {r["name"] for r in (ledger or {}).get("files", [])})
            if unknown:
                raise ValueError(f"unknown files: {unknown[:4]}")
            if ledger and ledger["identity"] != self.identity:
                raise ValueError("the folder was begun with other inputs or another configuration")
            self.done = ledger["files"] if ledger else []

    def write(self, iterator: Iterator) -> Written:
        there, at = opened(self.path)
        out, own = Written(), f"{self.staging}/{uuid.uuid4().hex}"
        there.create_dir(own, recursive=True)
        for i, row in enumerate(iterator):
            record = row.asDict(recursive=True)
            content = bytes(record.pop("content"))
            if not safe(record["name"]):
                raise ValueError(f"unsafe name: {record['name']!r}")
            with there.open_output_stream(f"{own}/{i}") as f:
                f.write(content)
            out.files.append((f"{own}/{i}", record | {"bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}))
        if self.resume:
            _put(there, f"{own}/{NOTE}", canonical_json({"identity": self.identity, "files": out.files}))
        return out

    def commit(self, messages) -> None:
        there, at = opened(self.path)
        there.create_dir(at, recursive=True)
        old = {r["name"] for r in (read_manifest(self.path) or {}).get("files", [])} if self.force else set()
        files = [f for m in messages if m is not None for f in m.files]
        records = sorted([r for _, r in files] + self.done, key=lambda r: r["name"])
        again = sorted({a["name"] for a, b in pairwise(records) if a["name"] == b["name"]})
        if again:
            raise ValueError(f"names repeat: {again[:4]}")
        _moved(there, at, files)
        _dropped(there, self.staging)
        for name in old - {r["name"] for r in records}:  # what the replaced manifest owned
            there.delete_file(f"{at}/{name}")
        _put(there, f"{at}/{MANIFEST}", canonical_json(signed(self.meta | {"identity": self.identity, "files": records})))
        if there.get_file_info(f"{at}/{LEDGER}").type == fs.FileType.File:
            there.delete_file(f"{at}/{LEDGER}")

    def abort(self, messages) -> None:
        there, _ = opened(self.path)
        if self.resume:
            adopt(self.path, self.identity)
        _dropped(there, self.staging)


def _moved(there: fs.FileSystem, at: str, files: list[tuple[str, dict]]) -> None:
    for folder in sorted({posixpath.dirname(r["name"]) for _, r in files} - {""}):
        there.create_dir(f"{at}/{folder}", recursive=True)
    with ThreadPoolExecutor(32) as pool:
        list(pool.map(lambda f: there.move(f[0], f"{at}/{f[1]['name']}"), files))


def _dropped(there: fs.FileSystem, folder: str) -> None:
    if there.get_file_info(folder).type == fs.FileType.Directory:
        there.delete_dir(folder)


def adopt(path: str, identity: str) -> None:
    """Moves what tasks of failed runs of this identity finished to its place and lists it in the ledger; the rest of those
    runs' staging goes. The ledger is written first: a file that it lists may be missing, but none is there that it
    doesn't know."""
    there, at = opened(path)
    at = at.rstrip("/")
    ledger = read_manifest(path, LEDGER)
    if ledger and ledger["identity"] != identity:
        raise ValueError("the folder was begun with other inputs or another configuration")
    known = {r["name"]: r for r in ledger["files"]} if ledger else {}
    found = there.get_file_info(fs.FileSelector(at, allow_not_found=True))
    runs = [i.path for i in found if i.type == fs.FileType.Directory and posixpath.basename(i.path).startswith(STAGING)]
    moves = {}
    for i in (x for run in runs for x in there.get_file_info(fs.FileSelector(run, recursive=True))):
        note = _text(there, i.path) if posixpath.basename(i.path) == NOTE else None
        if note and note["identity"] == identity:
            # Twins of a task wrote the same files; one of each stays.
            moves |= {r["name"]: (where, r) for where, r in note["files"] if r["name"] not in known}
    if moves:
        records = sorted([*known.values(), *(r for _, r in moves.values())], key=lambda r: r["name"])
        _put(there, f"{at}/{LEDGER}", canonical_json(signed({"identity": identity, "files": records})))
        _moved(there, at, list(moves.values()))
    for run in runs:
        _dropped(there, run)


class StagedFiles(DataSource):
    """format("staged_files"): options path, identity, resume, force, meta (JSON for the manifest). Columns besides name
    and content go to the file's record."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return StagedWriter(dict(self.options), schema.fieldNames())


def write_files(rows: DataFrame, path: str, identity: str = "", resume: bool = False, force: bool = False, meta: dict | None = None) -> dict:
    """Writes rows (name, content, ...) as files; returns the manifest."""
    rows.sparkSession.dataSource.register(StagedFiles)
    options = {"path": path, "identity": identity, "resume": str(resume), "force": str(force), "meta": json.dumps(meta or {})}
    rows.write.format("staged_files").options(**options).mode("append").save()
    return read_manifest(path)


def pending(rows: DataFrame, path: str, identity: str) -> DataFrame:
    """The rows whose files a run of this identity that failed hasn't finished; a file that the ledger lists but that isn't
    there is unfinished."""
    adopt(path, identity)
    ledger = read_manifest(path, LEDGER)
    if ledger is None:
        return rows
    there = {p for p, _ in files_below(path)}
    done = [(r["name"],) for r in ledger["files"] if r["name"] in there]
    return rows.join(rows.sparkSession.createDataFrame(done, "name string"), "name", "left_anti")


# --- digests -----------------------------------------------------------------------------------------------------------


@dataclass
class OneFile(InputPartition):
    path: str
    bytes: int


class DigestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))

    def partitions(self) -> list[OneFile]:
        return [OneFile(p, n) for p, n in files_below(self.path)]

    def read(self, partition: OneFile):
        there, at = opened(self.path)
        if there.get_file_info(at.rstrip("/")).type != fs.FileType.File:
            at = f"{at.rstrip('/')}/{partition.path}"
        digest, n = hashlib.sha256(), 0
        with there.open_input_stream(at) as f:
            while block := f.read(self.block):
                digest.update(block)
                n += len(block)
        yield partition.path, n, digest.hexdigest()


class FileDigests(DataSource):
    """format("file_digests"): path, bytes and sha256 of a file, or of all files of a folder (listed when first used), each
    streamed in blocks by a task of its own."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes bigint, sha256 string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(dict(self.options))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").load(path)


def changed_files(digests: DataFrame, manifest: dict) -> DataFrame:
    """(path, problem) of files that are missing, unlisted or changed against the manifest."""
    spark = digests.sparkSession
    listed = spark.createDataFrame([(r["name"], r["sha256"]) for r in manifest["files"]], "path string, listed string")
    both = digests.filter(~F.col("path").isin(MANIFEST, LEDGER)).select("path", "sha256").join(listed, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("sha256") != F.col("listed"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem is not null")
