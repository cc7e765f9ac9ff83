"""Source bundles as tables: scan, split into modules, archives, pages, and the evidence that a set is complete.

Bundles are rows; they are never joined into one text. Modules carry the number
of their bundle and their byte offsets, which say which copy comes first.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import lzma
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import js

MODULES = "bundle_ord long, module_ord int, name string, deps array<string>, start long, end long, factory_start long, factory_end long, slice string"
#: Limits of an archive: bytes once unpacked, bytes for the decoder, and files.
MOST_BYTES, DECODER_BYTES, MOST_FILES = 1 << 30, 65 << 20, 100_000


def scan(spark: SparkSession, path: str, glob: str = "*.js") -> DataFrame:
    """(bundle_ord, path, size, sha256, content): the files of a folder; bundle_ord numbers them by path.

    The number comes from the sorted list of paths, not from the contents, so
    that only names pass through one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    names = files.select("path").withColumn("_k", F.lit(0))
    order = names.groupBy("_k").agg(F.array_sort(F.collect_list("path")).alias("all")).select(F.posexplode("all").alias("bundle_ord", "_path"))
    out = files.join(F.broadcast(order), F.col("path") == F.col("_path"))  # names of files only
    return out.select(F.col("bundle_ord").cast("long").alias("bundle_ord"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def require_files(bundles: DataFrame) -> DataFrame:
    """The bundles, or an error if there are none."""
    if not bundles.select("path").limit(1).count():
        raise ValueError("no bundles found")
    return bundles


def split(bundles: DataFrame, strict: bool = False) -> DataFrame:
    """MODULES: one row for each module of each bundle (all copies), with byte offsets, end exclusive.

    Tolerant: bytes that aren't UTF-8 are replaced, and what can't be read is
    stepped over. Strict: either is an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for b in pdf.itertuples(index=False):
                text = bytes(b.content).decode("utf-8", "strict" if strict else "replace")
                found = js.definitions(text, strict)
                marks = sorted({p for d in found for p in (d.start, d.end, d.factory_start, d.factory_end)})
                at, done, byte = {}, 0, 0
                for p in marks:
                    byte += len(text[done:p].encode())
                    at[p], done = byte, p
                rows += [(b.bundle_ord, k, d.name, d.deps, at[d.start], at[d.end], at[d.factory_start], at[d.factory_end], text[d.start : d.end]) for k, d in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in MODULES.split(", ")])

    return bundles.select("bundle_ord", "content").mapInPandas(run, MODULES)


def spread(modules: DataFrame, parts: int | None = None) -> DataFrame:
    """Deals modules out evenly: one bundle may hold thousands of them."""
    return modules.repartition(parts, "bundle_ord", "module_ord") if parts else modules.repartition("bundle_ord", "module_ord")


def edges(modules: DataFrame) -> DataFrame:
    """(module, dep): the distinct dependencies of all copies."""
    return modules.select(F.col("name").alias("module"), F.explode("deps").alias("dep")).distinct()


def source_index(bundles: DataFrame, modules: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """(name, bundle_sha256, start, end, source_sha256): all copies of the selected modules (none selected: of all), ordered by hash and start when shown."""
    m = modules if not selected else modules.filter(F.col("name").isin(*selected))
    return m.join(bundles.select("bundle_ord", F.col("sha256").alias("bundle_sha256")), "bundle_ord").select("name", "bundle_sha256", "start", "end", F.sha2("slice", 256).alias("source_sha256"))


def _unpacked(data: bytes, most: int) -> bytes:
    """Contents of an xz or gzip stream by its first bytes, or the bytes themselves; an error beyond `most`."""
    if data[:6] == b"\xfd7zXZ\x00":
        got = lzma.LZMADecompressor(memlimit=DECODER_BYTES).decompress(data, most + 1)
    elif data[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            got = f.read(most + 1)
    else:
        got = data
    if len(got) > most:
        raise ValueError(f"more than {most} bytes once unpacked")
    return got


def unpack(archives: DataFrame, most: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """(archive, path, size, sha256, content): the plain files of tar archives (xz, gzip or bare); an empty archive, a folder above it or two files of one name are errors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in pdf.itertuples(index=False):
                rows, names = [], set()
                with tarfile.open(fileobj=io.BytesIO(_unpacked(bytes(a.content), most))) as tar:
                    for m in tar:
                        if not m.isfile():
                            continue
                        if m.name.startswith("/") or ".." in m.name.split("/") or m.name in names or len(names) >= most_files:
                            raise ValueError(f"{a.path}: {m.name} is not admitted")
                        names.add(m.name)
                        body = tar.extractfile(m).read()
                        rows.append((a.path, m.name, len(body), hashlib.sha256(body).hexdigest(), body))
                if not rows:
                    raise ValueError(f"{a.path}: no files")
                yield pd.DataFrame(rows, columns=["archive", "path", "size", "sha256", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, size long, sha256 string, content binary")


def set_hash(files: DataFrame) -> DataFrame:
    """One row: the hash of a set of files, whatever their order, and their number and bytes."""
    line = F.concat_ws(":", "sha256", F.col("size").cast("string"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("set_hash"), F.count("*").alias("bundle_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bundle_bytes"))


def write_lock(files: DataFrame, path: str, version: str) -> None:
    """The lockfile: one JSON document with the files sorted by hash and URL, and their set hash."""
    url = F.col("url") if "url" in files.columns else F.lit(None).cast("string")
    listed = files.agg(F.array_sort(F.collect_list(F.struct("sha256", url.alias("url"), "size"))).alias("bundles"))
    doc = listed.crossJoin(set_hash(files)).select(F.to_json(F.struct(F.lit(version).alias("version"), "set_hash", "bundle_count", "bundles")).alias("value"))  # one row by one row
    doc.coalesce(1).write.mode("overwrite").text(path)


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """(version, set_hash, sha256, url, size) of a lockfile."""
    schema = "version string, set_hash string, bundle_count long, bundles array<struct<sha256: string, url: string, size: long>>"
    return spark.read.schema(schema).json(path).select("version", "set_hash", F.explode("bundles").alias("b")).select("version", "set_hash", "b.*")


def lock_errors(lock: DataFrame) -> DataFrame:
    """Versions whose set hash isn't that of their files."""
    line = F.concat_ws(":", "sha256", F.col("size").cast("string"))
    now = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)
    return lock.groupBy("version", "set_hash").agg(now.alias("now")).filter("now <> set_hash")


def cached(spark: SparkSession, root: str, version: str, lock: DataFrame) -> DataFrame | None:
    """The cached files of a version, if they are all there and each has its size and hash; else None."""
    from ..operators.sets import multiset_diff

    try:
        found = spark.read.parquet(f"{root}/wa_version={version}")
    except Exception as e:  # noqa: BLE001  Spark has one class for a path that isn't there
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    actual = found.select(F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    return None if multiset_diff(actual, lock.select(F.col("size").cast("long").alias("size"), "sha256"), ["size", "sha256"]).limit(1).count() else found


def write_cache(files: DataFrame, root: str, version: str) -> None:
    """Writes a version's files; Spark's commit makes them visible at once, or not at all."""
    files.write.mode("overwrite").parquet(f"{root}/wa_version={version}")


_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.I | re.S)
_ATTR = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_REVISION = re.compile(r"\"client_revision\"\s*:\s*(\d+)")


def _urls(value, out: list[tuple[str, str]]) -> None:
    """Script and binary addresses anywhere in a JSON value, and handles of resources: {"bx": {"id": {"uri": ...}}}."""
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, dict) and isinstance(v.get("uri"), str) and k.isdigit():
                out.append(("bx", f"{k} {v['uri']}"))
            _urls(v, out)
    elif isinstance(value, list):
        for v in value:
            _urls(v, out)
    elif isinstance(value, str) and re.match(r"(?:https?:)?//\S+$", value):
        tail = value.split("?", 1)[0].split("#", 1)[0]
        if tail.endswith((".js", ".wasm")):
            out.append(("js" if tail.endswith(".js") else "wasm", value))


def discover(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, kind, value): what pages refer to: js and wasm addresses of script tags and of their JSON data, bx handles ("id address"), and the version of the client."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                found: list[tuple[str, str]] = []
                for m in _SCRIPT.finditer(text or ""):
                    attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[1])}
                    if attrs.get("src"):
                        found.append(("js", attrs["src"].replace("&amp;", "&")))
                    if "data-sjs" in attrs or attrs.get("type", "").endswith("json"):
                        try:
                            _urls(json.loads(m[2]), found)
                        except ValueError:
                            pass
                found += [("version", f"2.3000.{r}") for r in _REVISION.findall(text or "")[:1]]
                rows += [(k, kind, value) for kind, value in dict.fromkeys(found)]
            yield pd.DataFrame(rows, columns=[key, "kind", "value"])

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, kind string, value string")


def fetched(urls: DataFrame, get, folder: str, workers: int = 16, most: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
    """(obtained (url, content, sha256, size), failed (url, why)) of get(url) -> bytes over `workers` tasks; a failure is a row, not an exception. `get` is the caller's client.

    What is fetched is written to `folder`, which all executors reach, so that a lost executor fetches nothing twice.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for url in pdf["url"]:
                try:
                    body = get(url)
                    if len(body) > most:
                        raise ValueError(f"more than {most} bytes")
                    rows.append((url, body, None))
                except Exception as e:  # noqa: BLE001  each address reports for itself
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "content", "why"])

    schema = "url string, content binary, why string"
    urls.select("url").distinct().repartition(workers, "url").mapInPandas(run, schema).write.mode("overwrite").parquet(folder)
    every = urls.sparkSession.read.schema(schema).parquet(folder)
    good = every.filter("why IS NULL").select("url", "content", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))
    return good, every.filter("why IS NOT NULL").select("url", "why")


def from_folder_or_client(spark: SparkSession, folder: str | None, urls: DataFrame | None = None, get=None, store: str | None = None) -> tuple[DataFrame, bool]:
    """(bundles, authoritative): a folder is read as it stands and never says what the current set is; a client's downloads do, if every address was obtained."""
    if folder is not None:
        return require_files(scan(spark, folder)), False
    good, failed = fetched(urls, get, store)
    lost = failed.orderBy("url").limit(3).collect()
    if lost:
        raise ValueError("incomplete: " + "; ".join(f"{r.url}: {r.why}" for r in lost))
    order = good.select("url").withColumn("_k", F.lit(0)).groupBy("_k").agg(F.array_sort(F.collect_list("url")).alias("all")).select(F.posexplode("all").alias("bundle_ord", "_url"))
    named = good.join(F.broadcast(order), F.col("url") == F.col("_url"))  # addresses only
    return named.select(F.col("bundle_ord").cast("long").alias("bundle_ord"), F.col("url").alias("path"), "size", "sha256", "content"), True


def restored(archives: DataFrame, lock: DataFrame, samples: int = 3) -> DataFrame:
    """The files of archives, verified against a lock: the same hashes and sizes, as often; an error names up to `samples` missing and extra ones. Nothing comes back of a set that differs."""
    from ..operators.sets import multiset_diff

    files = unpack(archives)
    key = ["sha256", "size"]
    sizes = lambda df: df.select("sha256", F.col("size").cast("long").alias("size"))
    odd = multiset_diff(sizes(lock), sizes(files), key).withColumn("what", F.when(F.col("n_left") > F.col("n_right"), "missing").otherwise("extra"))
    shown = odd.groupBy("what").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("sha256")), 1, samples).alias("some")).orderBy("what").collect()
    if shown:
        raise ValueError("; ".join(f"{r['n']} {r['what']}: {', '.join(r['some'])}" for r in shown))
    return files
