"""Sources and sinks: office documents, parsed JSON, tables in text, logs, stores."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import schemas

TABLE_TYPE = "array<struct<table_index:int,page_number:int,headers:array<string>,rows:array<array<string>>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def kind_of(path: Column) -> Column:
    """Which reader a file needs."""
    low = F.lower(path)
    return F.when(low.endswith(".docx"), "docx").when(low.endswith(".doc"), "doc").when(low.endswith(".pdf"), "pdf").when(low.endswith(".json"), "json").otherwise("text")


def parse_docx(data: bytes) -> tuple[str, list[dict]]:
    """Body text and tables of a word-processor file; blank paragraphs, empty rows and tables of a head alone are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    lines, tables = [], []
    for child in body if body is not None else []:
        if child.tag == f"{_W}p":
            text = re.sub(r"^(Điều\s+\d+[a-zA-Z]*)\s+(?=[^\s.])", r"\1. ", words(child))
            if text:
                lines.append(text)
        elif child.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(words, cell.iter(f"{_W}p")))) for cell in row.findall(f"{_W}tc")] for row in child.findall(f"{_W}tr")]
            rows = [r for r in rows if any(r)]
            if len(rows) > 1:
                tables.append({"table_index": len(tables), "page_number": 0, "headers": rows[0], "rows": rows[1:]})
    return "\n".join(lines), tables


def parse_pipe_tables(text: str) -> tuple[str, list[dict]]:
    """Text with runs of |a|b| lines taken out as tables; rules between rows dropped, rows padded."""
    lines, tables, run = [], [], []

    def close() -> None:
        nonlocal run
        rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in run]
        rows = [r for r in rows if not all(re.fullmatch(r"[-=+ ]*", c) for c in r)]
        if len(run) >= 2 and rows:
            width = max(map(len, rows))
            rows = [r + [""] * (width - len(r)) for r in rows]
            tables.append({"table_index": len(tables), "page_number": 0, "headers": rows[0], "rows": rows[1:]})
        else:
            lines.extend(run)
        run = []

    for line in text.split("\n"):
        if re.match(r"\s*\|.*\|\s*$", line):
            run.append(line)
        else:
            close()
            lines.append(line)
    close()
    return "\n".join(lines), tables


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """.docx files from any store: (path, text, tables, error); a bad file gives its error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"]):
                try:
                    text, tables = parse_docx(bytes(data))
                    out.append((p, text, tables, None))
                except Exception as e:  # a bad file must not end the scan
                    out.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "tables", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(run, f"path string, text string, tables {TABLE_TYPE}, error string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files whole: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def split_tables(texts: DataFrame) -> DataFrame:
    """(path, text, tables) of texts with pipe tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [parse_pipe_tables(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"path": pdf["path"], "text": [m[0] for m in made], "tables": [m[1] for m in made]})

    return texts.select("path", "text").mapInPandas(run, f"path string, text string, tables {TABLE_TYPE}")


NODE_SCHEMA = "doc_id string, node_id string, parent_id string, seq int, depth int, node_type string, node_index string, title string, content string, lead_in string, trailing string, breadcrumb string, refs array<string>, error string"


def _walk(doc: str, nodes: list[dict], parent: str | None, depth: int, out: list[tuple]) -> None:
    for n in nodes or []:
        text = lambda k, n=n: n.get(k) or ""
        out.append((doc, n.get("node_id"), parent, len(out), depth, n.get("node_type"), n.get("node_index"), n.get("title"), text("content"), text("lead_in_text"), text("trailing_text"), text("breadcrumb"), [r.get("target_id") for r in n.get("references") or []], None))
        _walk(doc, n.get("children"), n.get("node_id"), depth + 1, out)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents in JSON as a flat node table; a file that is none gives one row with its name and error alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for p, text in zip(pdf["path"], pdf["text"]):
                try:
                    doc = json.loads(text)
                    rows: list[tuple] = []
                    _walk((doc.get("metadata") or {}).get("document_id") or re.sub(r".*/|\.json$", "", p), doc.get("data"), None, 0, rows)
                    out += rows
                except (ValueError, AttributeError) as e:
                    out.append((re.sub(r".*/|\.json$", "", p), *[None] * 12, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return read_texts(spark, path).mapInPandas(run, NODE_SCHEMA)


MANIFEST_SCHEMA = (
    "documents map<string, struct<doc_number:string,name:string,effective_from:date,effective_to:date,status:string,status_changed_date:date,role:string,"
    "supersedes:array<string>,superseded_by:string,note:string,exception_use:struct<allowed:boolean,reason:string,semantic_intent_description:string,"
    "test_should_match:array<string>,test_should_not_match:array<string>>>>, not_in_database map<string, struct<name:string,note:string,superseded_by:string>>"
)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The validity manifest: documents, and those known to be missing."""
    raw = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    docs = raw.select(F.explode("documents").alias("doc_id", "d")).select("doc_id", "d.*")
    return docs, raw.select(F.explode("not_in_database").alias("doc_id", "d")).select("doc_id", "d.*")


def manifest_lists(docs: DataFrame) -> dict[str, DataFrame]:
    return {
        "active": docs.where(F.col("status").startswith("active")),
        "superseded": docs.where("status = 'superseded'"),
        "exceptions": docs.where("exception_use.allowed"),
        "all": docs,
    }


def pdf_kind(pages: DataFrame, digital: int = 500, scanned: int = 50) -> DataFrame:
    """digital, scanned_ocr or scanned_pure by the mean text of a file's first three pages: pages (path, page, text)."""
    mean = F.avg(F.length(F.trim(F.coalesce("text", F.lit("")))))
    kind = F.when(F.col("mean") > digital, "digital").when(F.col("mean") > scanned, "scanned_ocr").otherwise("scanned_pure")
    return pages.where("page <= 3").groupBy("path").agg(mean.alias("mean")).select("path", kind.alias("kind"))


def best_tables(found: DataFrame) -> DataFrame:
    """Tables of the first strategy that found any on a page: found (path, page, strategy_order, strategy, headers, rows)."""
    clean = lambda row: F.transform(row, lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))
    rows = found.select("path", "page", "strategy_order", "strategy", clean(F.col("headers")).alias("headers"), F.filter(F.transform("rows", clean), lambda r: F.exists(r, lambda c: c != "")).alias("rows")).where(F.size("rows") >= 1)
    w = Window.partitionBy("path", "page")
    return rows.withColumn("best", F.min("strategy_order").over(w)).where("best = strategy_order").drop("best", "strategy_order")


def pick_files(files: DataFrame) -> DataFrame:
    """One file for each stem: .docx before .pdf before .doc: files (path)."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    order = F.when(kind_of(F.col("path")) == "docx", 1).when(kind_of(F.col("path")) == "pdf", 2).when(kind_of(F.col("path")) == "doc", 3).otherwise(9)
    return files.groupBy(stem.alias("stem")).agg(F.min_by("path", F.struct(order, "path")).alias("path"))


def parse_status(error: Column, nodes: Column, warnings: Column, skipped: Column) -> Column:
    return F.when(skipped, "SKIP").when(error.isNotNull() | (nodes == 0), "FAIL").when(warnings > 0, "PARTIAL").otherwise("SUCCESS")


def cache_misses(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """Files whose text is not held yet, or is too short to be one: the ones for a plug-in reader."""
    return files.join(extracted.where(F.length("text") >= 100).select("path"), "path", "left_anti")


def upsert(store: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A store with rows put in by key: idempotent."""
    return store.join(rows.select(key), key, "left_anti").select(*store.columns).unionByName(rows.select(*store.columns))


def by_ids(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_semi")


def first_of_doc(store: DataFrame, doc: str, n: int) -> DataFrame:
    """The first chunks of a document, in document order."""
    w = Window.partitionBy("doc_id").orderBy("seq", "chunk_id")
    return store.where(F.col("doc_id") == doc).withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= n).drop("n__")


#: Folders of a store: chunks are spread by the hash of their document.
BUCKETS = 64


def write_store(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Chunks as Parquet in a fixed number of folders by hash of their document, sorted by document and kind.

    A document's scan reads one folder, and in it the row groups of its range.
    """
    dealt = chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    dealt.repartition(buckets, "bucket", F.pmod(F.xxhash64(*chunks.columns[:2]), F.lit(8))).sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def scan_store(spark: SparkSession, path: str, doc: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """All chunks of a store, or those of one document from its own folder."""
    rows = spark.read.parquet(path)
    if doc is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc)), F.lit(buckets)).cast("int")).first()[0]
        rows = rows.where((F.col("bucket") == bucket) & (F.col("doc_id") == doc))
    return rows.drop("bucket")


def count_store(store: DataFrame) -> DataFrame:
    """How many chunks each document has."""
    return store.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def delete_docs(store: DataFrame, docs: DataFrame) -> DataFrame:
    """A store without the chunks of documents: docs (doc_id)."""
    return store.join(docs.select("doc_id").distinct(), "doc_id", "left_anti")


def export_document(chunks: DataFrame) -> DataFrame:
    """One JSON text for each document, with counts by type: chunks (doc_id, seq, kind, ...)."""
    counts = chunks.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("chunk_types"))
    whole = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"), F.array_sort(F.collect_list(F.struct("seq", *[c for c in chunks.columns if c not in ("doc_id", "seq")]))).alias("chunks"))
    return whole.join(counts, "doc_id").select("doc_id", F.to_json(F.struct("total_chunks", "chunk_types", "chunks")).alias("json"))


def append_log(rows: DataFrame, path: str) -> None:
    """Answers as JSON lines, appended."""
    rows.write.mode("append").json(path)


def stream_log(rows: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_rows(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Rows of one of the engine's tables (nodes, chunks, result, cache, patches, ...) from JSON lines; missing fields are null, others left out."""
    return spark.read.schema(getattr(schemas, kind.upper())).json(path)


def sessions(messages: DataFrame) -> DataFrame:
    """Conversations, the last one changed first: messages (conv_id, turn, role, text, ts)."""
    title = F.min_by(F.substring("text", 1, 60), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(title.alias("title"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("messages")).orderBy(F.desc("updated_at"), "conv_id")


def save_sessions(store: DataFrame, messages: DataFrame) -> DataFrame:
    """A store of messages (conv_id, turn, role, text, ts) with sessions put in; a session saved again replaces its old messages."""
    return store.join(messages.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(messages.select(*store.columns))


def load_session(store: DataFrame, conv: int) -> DataFrame:
    return store.where(F.col("conv_id") == conv).orderBy("turn")


def delete_sessions(store: DataFrame, convs: DataFrame) -> DataFrame:
    return store.join(convs.select("conv_id").distinct(), "conv_id", "left_anti")


def read_registry_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of the classic nested model; dates in ISO, unknown fields left out, bad rows kept aside."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=True)
