"""Sources and sinks: line files, configuration, manifests, cached API records, versioned tables."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, size double, flags int"
TABLES = "doc_id string, table_no int, page int, bbox array<double>, rows array<array<string>>, h_rules int, v_rules int"
QUESTION = "id string, question string, category string, topic string, expect_route string, expect_ids array<string>, expect_facts string, must_not array<string>, expect_section_types array<string>, expect_scope string, note string"
CATEGORIES = ("graph", "retrieve", "both", "edge", "retrieval")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Layout spans as JSON lines: the interface to any PDF decoder."""
    return spark.read.schema(SPANS).json(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLES).json(path)


def html_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Layout rows of HTML pages: headings bold and large, paragraphs and list items in body size; one page each."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<(h1|h2|h3|p|li)\b[^>]*>(.*?)</\1>"), F.lit(0))
    rows = pages.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(found).alias("row_no", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]+>", " "), r"\s+", " "))
    size = F.when(tag == "h1", 16.0).when(tag == "h2", 14.0).when(tag == "h3", 12.0).otherwise(10.0)
    zero = F.lit(0.0)
    return rows.select("doc_id", F.lit(1).alias("page"), "row_no", zero.alias("x0"), zero.alias("y0"), zero.alias("x1"), zero.alias("y1"), text.alias("text"), size.alias("size"), tag.startswith("h").alias("bold")).where("text != ''")


def read_questions(spark: SparkSession, *paths: str) -> DataFrame:
    """Evaluation questions of JSON-line files; a missing id or question, a repeated id or an unknown category is an error."""
    df = spark.read.schema(QUESTION).json(list(paths)).where("id IS NOT NULL OR question IS NOT NULL")
    bad = df.where("id IS NULL OR question IS NULL").limit(1).count()
    if bad:
        raise ValueError("a question lacks its id or text")
    twice = [r.id for r in df.groupBy("id").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"repeated ids: {', '.join(twice)}")
    other = [r.category for r in df.where(F.col("category").isNotNull() & ~F.col("category").isin(*CATEGORIES)).select("category").distinct().limit(5).collect()]
    if other:
        raise ValueError(f"unknown categories: {', '.join(other)}")
    lists = ("expect_ids", "must_not", "expect_section_types")
    # string or list of strings, or lists of lists: always lists of alternatives
    def alternatives(c: str):
        wrapped = F.when(F.col(c).isNull(), "[]").when(F.ltrim(F.col(c)).startswith("["), F.col(c)).otherwise(F.concat(F.lit('["'), F.col(c), F.lit('"]')))
        return F.transform(F.from_json(wrapped, "array<string>"), lambda x: F.coalesce(F.from_json(F.when(F.ltrim(x).startswith("["), x), "array<string>"), F.array(x)))

    return df.select(*[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in lists else alternatives(c).alias(c) if c in ("expect_route", "expect_facts") else F.col(c) for c in df.columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)`` of text files; lines are numbered within the file."""
    raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_name")).withColumn("at", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    from pyspark.sql import Window

    return raw.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).alias("line"), "value")


def load_types(path: str | Path) -> tuple[dict[str, list[str]], dict[str, list[str]], dict[str, list[str]]]:
    """(types, groups, core) of a section-type file; each subtype must be in exactly one group, and core needs a default."""
    data = json.loads(Path(path).read_text())
    groups = {k: v for k, v in data["groups"].items() if not k.startswith("_")}
    types = {k: v for k, v in data["types"].items() if not k.startswith("_")}
    core = {k: v for k, v in data["core"].items() if not k.startswith("_")}
    listed = [s for subs in groups.values() for s in subs]
    wrong = sorted({s for s in listed if listed.count(s) > 1} | set(types) ^ set(listed))
    if wrong:
        raise ValueError(f"subtypes not in exactly one group: {', '.join(wrong)}")
    if "default" not in core:
        raise ValueError("core has no default")
    return types, groups, core


def load_aliases(path: str | Path) -> dict[str, str]:
    """Folded spelling to canonical name, from an alias file (``organizations``: name -> spellings); one spelling of two names is an error."""
    out: dict[str, str] = {}
    for name, spellings in json.loads(Path(path).read_text())["organizations"].items():
        for s in [name, *spellings]:
            key = fold(s)
            if out.setdefault(key, name) != name:
                raise ValueError(f"{s!r} is a spelling of {out[key]!r} and of {name!r}")
    return out


def load_countries(spark: SparkSession, path: str | Path) -> DataFrame:
    """``(name_norm, canonical, iso2, region)``, a row for every name, alias and code of a country file."""
    rows = []
    for name, e in json.loads(Path(path).read_text())["countries"].items():
        rows += [(key, name, e["iso2"], e["region"]) for key in dict.fromkeys(fold(x) for x in (name, *e.get("aliases", []), e["iso2"], *e.get("api_codes", [])))]
    return spark.createDataFrame(rows, "name_norm string, canonical string, iso2 string, region string").dropDuplicates(["name_norm"])


def fold(text: str) -> str:
    """The folded form of a name on the driver, as ``functions.text.name_norm`` has it in plans."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub("[^a-z0-9]+", " ", flat).strip()


def pair_extractions(sections: DataFrame, datasheets: DataFrame, stem: str = "stem", only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, notes): records joined by stem, and one note for every stem without a mate."""
    a, b = (df if only is None else df.where(F.col(stem).isin(only)) for df in (sections, datasheets))
    joined = a.select(stem, F.lit(True).alias("_a")).distinct().join(b.select(stem, F.lit(True).alias("_b")).distinct(), stem, "full")
    notes = joined.where("_a IS NULL OR _b IS NULL").select(stem, F.when(F.col("_a").isNull(), "no sections").otherwise("no datasheet").alias("note"))
    return a.join(b, stem), notes


def verify_manifest(spark: SparkSession, files: str, manifest: DataFrame) -> DataFrame:
    """``(filename, status)``: ok, changed or missing, by SHA-256 of the whole file."""
    have = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("have"))
    status = F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.join(have, "filename", "left").select("filename", status.alias("status"))


def fetch_files(entries: list[dict], folder: str | Path, fetch: Callable[[str], bytes], check_only: bool = False) -> dict[str, str]:
    """Status of every manifest entry (filename, url, sha256): ok, fetched, changed or missing. Right files are not fetched again; a file
    appears under its name only when its hash is right. A manifest has a handful of files, so this runs on the driver; large ones use :func:`verify_manifest`."""
    out = {}
    for e in entries:
        path = Path(folder) / e["filename"]
        right = path.exists() and hashlib.sha256(path.read_bytes()).hexdigest() == e["sha256"]
        out[e["filename"]] = "ok" if right else "changed" if path.exists() else "missing"
        if right or check_only:
            continue
        part = path.with_name(path.name + ".part")
        try:
            part.write_bytes(fetch(e["url"]))
            if hashlib.sha256(part.read_bytes()).hexdigest() == e["sha256"]:
                part.rename(path)
                out[e["filename"]] = "fetched"
        except Exception as error:
            out[e["filename"]] = f"error: {error}"[:200]
        finally:
            part.unlink(missing_ok=True)
    return out


def api_records(ids: DataFrame, cache: DataFrame, fetch: Callable[[str], dict | None] | None = None) -> DataFrame:
    """``(project_id, payload, how)``: cached records; ``fetch`` fills misses if given. Personal fields are dropped before caching.

    ``cache``: project_id, payload (JSON). Only the misses of this call reach ``fetch``, on executors.
    """
    joined = ids.select("project_id").distinct().join(cache.select("project_id", "payload"), "project_id", "left")
    if fetch is None:
        return joined.select("project_id", "payload", F.when(F.col("payload").isNull(), "not_found").otherwise("cache").alias("how"))

    def run(batches):
        for pdf in batches:
            rows = []
            for key in pdf["project_id"]:
                try:
                    got = fetch(key)
                    rows.append((key, json.dumps({k: v for k, v in got.items() if not (k.lower().startswith("team") or "email" in k.lower())}) if got else None, "fetched" if got else "not_found"))
                except Exception:
                    rows.append((key, None, "error"))
            yield pdf.assign(payload=[r[1] for r in rows], how=[r[2] for r in rows])[["project_id", "payload", "how"]]

    misses = joined.where("payload IS NULL").select("project_id").mapInPandas(run, "project_id string, payload string, how string")
    return joined.where("payload IS NOT NULL").select("project_id", "payload", F.lit("cache").alias("how")).unionByName(misses)


def write_version(df: DataFrame, root: str) -> str:
    """Write a new version directory of a table, then switch the pointer file; readers of the old one are not disturbed."""
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    _point(df.sparkSession, root, [version])
    return version


def write_buckets(df: DataFrame, root: str, bucket: str, keep: dict[int, str]) -> None:
    """Write the rows of some buckets as new directories and point to them and to those of ``keep``: other buckets are not rewritten."""
    spark = df.sparkSession
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.partitionBy(bucket).parquet(version)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(version)
    fresh = {int(f.getPath().getName().split("=")[1]): f"{version}/{f.getPath().getName()}" for f in base.getFileSystem(conf).listStatus(base) if f.getPath().getName().startswith(f"{bucket}=")}
    _point(spark, root, [p for _, p in sorted({**keep, **fresh}.items())])


def bucket_paths(spark: SparkSession, root: str) -> dict[int, str] | None:
    """Directory of each bucket of a table; None if the table is not stored by buckets, and empty if there is none."""
    paths = _pointed(spark, root)
    if not all("=" in p.rsplit("/", 1)[-1] for p in paths):
        return None
    return {int(p.rsplit("=", 1)[-1]): p for p in paths}


def _point(spark: SparkSession, root: str, paths: list[str]) -> None:
    """Switch the pointer of a table to ``paths`` by one rename that replaces it: no reader finds it missing or half written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    temporary, pointer = path(f"{root}/_current.{uuid.uuid4().hex}"), path(f"{root}/_current")
    out = fs.create(temporary, True)
    out.write(bytearray("\n".join(paths).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(temporary), fs.makeQualified(pointer), overwrite)


def prune_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the ``keep`` newest versions of a table (never the current one); returns how many went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    current = _pointed(spark, root)
    found = sorted(((s.getModificationTime(), s.getPath()) for s in fs.listStatus(base) if s.isDirectory() and s.getPath().getName().startswith("v-")), key=lambda x: -x[0])
    old = [p for _, p in found[keep:] if not any(f"/{p.getName()}" in c for c in current)]
    for p in old:
        fs.delete(p, True)
    return len(old)


def _pointed(spark: SparkSession, root: str) -> list[str]:
    """The directories that the pointer names; none without one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_current")
    fs = pointer.getFileSystem(conf)
    if not fs.exists(pointer):
        return []
    # names that start with an underscore are hidden from file sources, so the pointer is read as a stream
    stream = fs.open(pointer)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().split("\n")
    finally:
        stream.close()


def read_version(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version of a table, or None if it has none."""
    paths = _pointed(spark, root)
    return spark.read.parquet(*paths) if paths else None


def write_html(nodes: DataFrame, edges: DataFrame, path: str, most: int = 2000) -> int:
    """A self-contained HTML page of a small graph layer, drawn and listed; refuses more than ``most`` nodes. Returns the nodes written."""
    from html import escape

    rows = nodes.select("id", "label", "name").orderBy("label", "id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} nodes: render a smaller layer")
    links = edges.select("src", "type", "dst").orderBy("type", "src", "dst").limit(10 * most + 1).collect()
    if len(links) > 10 * most:
        raise ValueError(f"more than {10 * most} edges: render a smaller layer")
    labels = sorted({r.label for r in rows})
    # a ring for each label, its nodes at even angles
    place = {}
    for ring, label in enumerate(labels):
        mine = [r.id for r in rows if r.label == label]
        for i, key in enumerate(mine):
            angle, radius = 2 * math.pi * (i + 0.5 * (ring % 2)) / len(mine), 80 + 90 * ring
            place[key] = (round(math.cos(angle) * radius, 1), round(math.sin(angle) * radius, 1))
    size = 80 + 90 * len(labels)
    drawn = "".join(f"<line x1='{place[r.src][0]}' y1='{place[r.src][1]}' x2='{place[r.dst][0]}' y2='{place[r.dst][1]}' stroke='#999'><title>{escape(r.type)}</title></line>" for r in links if r.src in place and r.dst in place)
    drawn += "".join(f"<g><circle cx='{place[r.id][0]}' cy='{place[r.id][1]}' r='6' fill='hsl({360 * labels.index(r.label) // max(1, len(labels))} 60% 50%)'/><text x='{place[r.id][0] + 8}' y='{place[r.id][1]}' font-size='9'>{escape(r.name or r.id)}</text></g>" for r in rows)
    body = "".join(f"<li><b>{escape(r.label)}</b> {escape(r.name or r.id)}</li>" for r in rows)
    lines = "".join(f"<li>{escape(r.src)} —{escape(r.type)}→ {escape(r.dst)}</li>" for r in links)
    Path(path).write_text(f"<!doctype html><meta charset='utf-8'><title>graph</title><svg viewBox='{-size} {-size} {2 * size} {2 * size}' width='{2 * size}'>{drawn}</svg><ul>{body}</ul><ul>{lines}</ul>")
    return len(rows)
