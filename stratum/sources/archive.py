"""ZIP and tar archives as DataFrames, read in chunks of entries, and written one archive per partition, or one in all.

A ZIP's directory is read on the driver; a partition is a range of its entries, and filters on layer and text_id prune
entries before any is decompressed. Paths must be reachable by all executors, as for any file source of Python.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import re
import shutil
import tarfile
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..functions.text import glob_regex

SCHEMA = "archive string, path string, text_id string, foundry string, layer string, xml string"
CHUNK = 256
LAYERS = ("data", "tokens", "structure", "morpho", "dependency", "sentences", "constituency", "header")


def entry_key(archive: str, path: str) -> tuple[str, str, str]:
    """(text_id, foundry, layer) of an entry. The foundry is the archive's; in a base archive the folder names it."""
    parts = path.split("/")
    layer = parts[-1].removesuffix(".xml")
    text = f"{parts[0]}_{parts[1]}.{parts[2]}" if len(parts) >= 4 else parts[0]
    name = os.path.basename(archive).split(".")
    foundry = name[1] if len(name) > 2 else "base"
    if foundry == "base" and len(parts) >= 5 and layer not in ("data", "tokens", "structure", "header"):
        foundry = parts[3] if parts[3] not in ("", "base") else foundry
    if "-" in foundry and layer in ("morpho", "dependency"):
        foundry = foundry.split("-")[layer == "dependency"]
    return text, foundry, layer


def with_base(paths: list[str]) -> list[str]:
    """Annotation archives bring the base archive beside them."""
    out = dict.fromkeys(paths)
    for p in paths:
        parts = os.path.basename(p).split(".")
        base = os.path.join(os.path.dirname(p), f"{parts[0]}.zip")
        if len(parts) > 2 and os.path.exists(base):
            out.setdefault(base)
    return list(out)


def surface_inputs(paths: list[str]) -> list[str]:
    """For plain text without annotations: each annotation archive gives way to the base archive beside it, named once."""
    planned = []
    for p in paths:
        parts = os.path.basename(p).split(".")
        base = os.path.join(os.path.dirname(p), f"{parts[0]}.zip")
        planned.append(base if len(parts) > 2 and os.path.exists(base) else p)
    return list(dict.fromkeys(planned))


def largest_first(paths: list[str]) -> list[str]:
    """Paths by falling size, so that the longest work starts first."""
    return sorted(paths, key=lambda p: (-(os.path.getsize(p) if os.path.exists(p) else 0), p))


def excluded(path: str, globs: str) -> bool:
    """Whether a file's name matches one of the comma-separated ``globs``, in which only * and ? are special."""
    return any(re.match(glob_regex(g.strip()), os.path.basename(path)) for g in globs.split(",") if g.strip())


class _Part(InputPartition):
    def __init__(self, archive: str, names: list[str]):
        self.archive, self.names = archive, names


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.paths = with_base(sorted(p for x in options["path"].split(",") for p in (glob.glob(x) or [x])))
        if skip := options.get("exclude"):
            self.paths = [p for p in self.paths if not excluded(p, skip)]
        if str(options.get("largestFirst", "")).lower() == "true":
            self.paths = largest_first(self.paths)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("layer",), ("text_id",), ("foundry",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            yield f  # checked again by Spark

    def _keeps(self, archive: str, path: str) -> bool:
        key = dict(zip(("text_id", "foundry", "layer"), entry_key(archive, path)))
        return key["layer"] in LAYERS and all(key[k] in v for k, v in self.wanted.items())

    def partitions(self):
        out = []
        for p in self.paths:
            with zipfile.ZipFile(p) as z:
                names = [n for n in z.namelist() if n.endswith(".xml") and self._keeps(p, n)]
            out += [_Part(p, names[i : i + CHUNK]) for i in range(0, len(names), CHUNK)]
        return out or [_Part("", [])]

    def read(self, part):
        if part.names:
            with zipfile.ZipFile(part.archive) as z:
                for n in part.names:
                    yield (part.archive, n, *entry_key(part.archive, n), z.read(n).decode("utf-8"))


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class ArchiveWriter(DataSourceWriter):
    """Archives under ``path``, written beside their names and moved in place when all tasks are done.

    A path that ends in .zip or .tar becomes one archive: the parts' entries are put together by copying their bytes,
    without compressing them again. Any other path is a folder of one archive per partition. Option ``mode``: error (the
    default: what is there isn't written over) or overwrite."""

    def __init__(self, options, kind: str, overwrite: bool = False):
        self.path, self.kind, self.single = options["path"], kind, options["path"].endswith(f".{kind}")
        self.overwrite = overwrite or options.get("mode") == "overwrite"
        self.folder = self.path + ".parts" if self.single else self.path
        if self.single and os.path.exists(self.path) and not self.overwrite:
            raise FileExistsError(f"{self.path} is there already; mode=overwrite replaces it")
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows):
        name = os.path.join(self.folder, f".part-{uuid.uuid4().hex}.{self.kind}")
        if self.kind == "zip":
            with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
                for r in rows:
                    info = zipfile.ZipInfo(r[0])
                    info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
                    z.writestr(info, bytes(r[1]))
        else:
            with tarfile.open(name, "w") as t:
                for r in rows:
                    info = tarfile.TarInfo(r[0])
                    info.size = len(r[1])
                    if len(r) > 2 and r[2] is not None:
                        info.mtime = r[2]
                    t.addfile(info, io.BytesIO(bytes(r[1])))
        return _Written(name)

    def commit(self, messages):
        parts = [m.path for m in messages if m]
        if not self.single:
            for i, p in enumerate(parts):
                os.replace(p, os.path.join(self.path, f"part-{i:05d}.{self.kind}"))
            return
        whole = f"{self.path}.{uuid.uuid4().hex}"
        (join_zips if self.kind == "zip" else join_tars)(parts, whole)
        os.replace(whole, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


def join_zips(parts: list[str], target: str) -> None:
    """One archive of the entries of ``parts``, whose compressed bytes are copied."""
    with zipfile.ZipFile(target, "w", allowZip64=True) as out:
        for p in parts:
            with zipfile.ZipFile(p) as z, open(p, "rb") as raw:
                for info in z.infolist():
                    raw.seek(info.header_offset + 26)
                    name, extra = (int.from_bytes(raw.read(2), "little") for _ in range(2))
                    raw.seek(info.header_offset + 30 + name + extra)
                    info.header_offset = out.fp.tell()
                    info.extra = b""
                    out.fp.write(info.FileHeader(info.file_size > 0x7FFFFFFF or info.compress_size > 0x7FFFFFFF))
                    left = info.compress_size
                    while left:
                        data = raw.read(min(left, 1 << 20))
                        out.fp.write(data)
                        left -= len(data)
                    out.filelist.append(info)
                    out.NameToInfo[info.filename] = info
                    out.start_dir = out.fp.tell()
                    out._didModify = True


def join_tars(parts: list[str], target: str) -> None:
    """One archive of the entries of ``parts``, whose blocks are copied."""
    with open(target, "wb") as out:
        for p in parts:
            with tarfile.open(p) as t:
                for _ in t:
                    pass
                end = t.offset  # behind the last entry: two blocks of zeros follow
            with open(p, "rb") as raw:
                while end > 0:
                    data = raw.read(min(end, 1 << 20))
                    out.write(data)
                    end -= len(data)
        out.write(b"\0" * 1024)


class ZipSource(DataSource):
    @classmethod
    def name(cls):
        return "layer_zip"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ZipReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options, "zip", overwrite)


class TarReader(DataSourceReader):
    """Entries in the archive's order. An archive is read by ``PARTS`` tasks side by side, each its own range of entries."""

    def __init__(self, options):
        self.paths = sorted(p for x in options["path"].split(",") for p in (glob.glob(x) or [x]))

    def partitions(self):
        out = []
        for p in self.paths:
            with tarfile.open(p) as t:  # the headers alone: contents are skipped by seeking
                entries = [(m.name, m.offset_data, m.size, int(m.mtime)) for m in t if m.isfile()]
            out += [_Part(p, entries[i : i + CHUNK]) for i in range(0, len(entries), CHUNK)]
        return out or [_Part("", [])]

    def read(self, part):
        if part.archive:
            with open(part.archive, "rb") as f:
                for name, at, size, mtime in part.names:
                    f.seek(at)
                    yield (name, f.read(size), mtime)


class TarSource(DataSource):
    @classmethod
    def name(cls):
        return "index_tar"

    def schema(self):
        return "name string, content binary, mtime long"

    def reader(self, schema):
        return TarReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options, "tar", overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)
    spark.dataSource.register(TarSource)


def _lz4():
    try:
        import lz4.frame
    except ModuleNotFoundError as absent:
        raise RuntimeError("entries compressed by lz4 need the lz4 package, which isn't installed") from absent
    return lz4.frame


def compress_entries(documents, level: int = 1, codec: str = "gz"):
    """(name, content) of (text_id, json): members without a time stamp, named C-D-T.json.gz, or .lz4 by that codec."""
    import pyarrow as pa

    def run(batches):
        pack = (lambda b: gzip.compress(b, level, mtime=0)) if codec == "gz" else _lz4().compress
        for b in batches:
            names = [re.sub("[_.]", "-", i) + f".json.{codec}" for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([pack(j.encode()) for j in b.column(1).to_pylist()], pa.binary())], ["name", "content"])

    return documents.select("text_id", "json").mapInArrow(run, "name string, content binary")


def expand_entries(entries):
    """(name, json) of the documents among (name, content): .json.gz and .json.lz4; other entries are left out."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                out.append((name, (gzip.decompress(content) if name.endswith(".gz") else _lz4().decompress(content)).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["name", "json"])

    return entries.filter(entries["name"].rlike(r"\.json\.(gz|lz4)$")).select("name", "content").mapInArrow(run, "name string, json string")


def repack_entries(documents, level: int = 1):
    """(name, content) of (name, json): by the codec that the name says."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            names = b.column("name").to_pylist()
            packed = [gzip.compress(j.encode(), level, mtime=0) if n.endswith(".gz") else _lz4().compress(j.encode()) for n, j in zip(names, b.column("json").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(packed, pa.binary())], ["name", "content"])

    return documents.select("name", "json").mapInArrow(run, "name string, content binary")


def merge_tar(old, patched):
    """Entries of an update: patched texts replace theirs, all others stay byte for byte, with their time; texts that are
    new are left out (see ``unmatched_entries``)."""
    from pyspark.sql import functions as F

    new = patched.select("name", F.col("content").alias("__new"))
    rest = [c for c in old.columns if c not in ("name", "content")]
    return old.join(new, "name", "left").select("name", F.coalesce("__new", "content").alias("content"), *rest)


def unmatched_entries(old, patched):
    """(name) of patched texts that the archive lacks."""
    return patched.select("name").join(old.select("name"), "name", "left_anti")


def texts_with_data(entries):
    """Entries of several archives for texts that have raw text in one of them; of a layer that two archives have, the
    first archive's by name."""
    from pyspark.sql import functions as F

    known = entries.filter("layer = 'data'").select("text_id").distinct()
    first = entries.groupBy("text_id", "foundry", "layer").agg(F.min("archive").alias("archive"))
    return entries.join(first, ["text_id", "foundry", "layer", "archive"], "left_semi").join(known, "text_id", "left_semi")
