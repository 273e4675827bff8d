"""Readers of corpus formats, checkpoints and lineage databases; writers with replace semantics."""

from __future__ import annotations

import hashlib
import json
import os
import re
import sqlite3
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from contextlib import closing
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window as W

from driftloom.sources import log
from driftloom.sources.log import Versioned  # noqa: F401
from driftloom.sources.store import hadoop_path, shared_dir, written

MENTIONS = "array<array<struct<name:string,type:string,sent_id:int,pos:array<int>>>>"
#: Labels as columns of equal length, the shape that all readers give.
LABELS = "struct<head:array<int>,tail:array<int>,relation_id:array<string>,relation_text:array<string>,evidence:array<array<int>>>"
LISTED = "array<struct<h:int,t:int,r:string,evidence:array<int>>>"
EXAMPLE = f"title string, sents array<array<string>>, vertexSet {MENTIONS}, labels {LABELS}"


def numbered(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """``rows`` with ``idx``, their place in the order in which they are read, from 0; the first ``limit`` of them.

    A row's place in its partition, and the sizes of the partitions before: one number per partition meets in one place.
    """
    local = F.monotonically_increasing_id()
    marked = written(rows.withColumn("_id", local), "numbered")
    part, place = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = marked.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("idx", F.col("_before") + place).drop("_part", "_before", "_id")
    return out if limit is None else out.where(F.col("idx") < limit)


def label_columns(labels: Column) -> Column:
    """Labels as an array of (h, t, r, evidence), pivoted to columns; absent evidence is empty."""
    labels = F.coalesce(labels, F.array().cast(LISTED))
    take = lambda make: F.transform(labels, make)
    return F.struct(take(lambda x: x["h"]).alias("head"), take(lambda x: x["t"]).alias("tail"), take(lambda x: x["r"]).alias("relation_id"), take(lambda x: x["r"]).alias("relation_text"), take(lambda x: F.coalesce(x["evidence"], F.array().cast("array<int>"))).alias("evidence"))


def read_docred(spark: SparkSession, path: str, prefix: str = "docred", split: str = "dev", limit: int | None = None) -> DataFrame:
    """(idx, document_id, title, sents, vertexSet, labels) from a JSON array, JSON lines or Parquet (a file or folder).

    Which of them it is is read off the data: Parquet by its name, an array by its first character. Labels may be lists of
    objects or columns; they come out as columns.
    """
    if path.rstrip("/").endswith(".parquet") or any(f.endswith(".parquet") for f in _names(spark, path)):
        raw = spark.read.parquet(path)
        listed = isinstance(raw.schema["labels"].dataType, ArrayType) if "labels" in raw.columns else False
        labels = label_columns(F.col("labels").cast(LISTED)) if listed else F.col("labels").cast(LABELS) if "labels" in raw.columns else F.lit(None).cast(LABELS)
    else:
        first = spark.read.text(path).where(F.trim("value") != "").first()
        array = bool(first) and first.value.lstrip().startswith("[")
        raw = spark.read.schema(f"title string, sents array<array<string>>, vertexSet {MENTIONS}, labels string").option("multiLine", str(array).lower()).json(path)
        text = F.ltrim("labels")
        labels = F.when(text.startswith("["), label_columns(F.from_json("labels", LISTED))).otherwise(F.from_json("labels", LABELS))
    docs = numbered(raw.select("title", "sents", F.col("vertexSet").cast(MENTIONS).alias("vertexSet"), labels.alias("labels")), limit)
    title = F.substring(F.regexp_replace("title", r"[^\p{L}\p{N}_-]", "_"), 1, 40)
    return docs.select("idx", F.concat_ws("-", F.lit(prefix), F.lit(split), F.format_string("%06d", "idx"), title).alias("document_id"), "title", "sents", "vertexSet", "labels")


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    status = [x for f in (found or []) for x in at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(f.getPath())]
    return [x.getPath().getName() for x in status]


def parquet_branch(spark: SparkSession, root: str, split: str) -> DataFrame:
    """The Parquet files of a split's folder, with labels as columns."""
    return read_docred(spark, f"{root}/{split}/*.parquet", split=split.rsplit("/", 1)[-1])


def write_lines(docs: DataFrame, path: str) -> None:
    """A JSON lines mirror of ``docs``; the committer makes it complete or absent."""
    docs.write.json(path)


def _clusters(docs: DataFrame) -> DataFrame:
    """``docs`` with ``named``: clusters that have a name, as (i, names, types), in order."""
    some = lambda c, field: F.array_distinct(F.filter(F.transform(c, lambda m: m[field]), lambda n: n.isNotNull() & (n != "")))
    each = F.transform("vertexSet", lambda c, i: F.struct(i.alias("i"), some(c, "name").alias("names"), some(c, "type").alias("types")))
    return docs.withColumn("named", F.filter(each, lambda c: F.size(c["names"]) > 0))


def entities(docs: DataFrame) -> DataFrame:
    """One row per cluster with a name: the first mention names it, distinct mentions are its aliases, its id keeps the cluster's place."""
    c = _clusters(docs).select("document_id", F.explode("named").alias("c"))
    return c.select("document_id", F.concat(F.col("document_id"), F.lit("::e"), "c.i").alias("entity_id"), F.col("c.names")[0].alias("canonical_name"), F.col("c.names").alias("aliases"), F.get("c.types", F.lit(0)).alias("entity_type"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    from driftloom.functions.text import detokenise

    s = docs.select("document_id", F.posexplode("sents").alias("sentence_index", "words"))
    return s.select("document_id", F.concat(F.col("document_id"), F.lit("::s"), "sentence_index").alias("sentence_id"), "sentence_index", detokenise(F.col("words")).alias("text"))


def gold_edges(docs: DataFrame) -> DataFrame:
    """Labels joined to the named clusters by place among them; a place without one keeps its number as name and has no id."""
    l = F.col("labels")
    zipped = F.transform(l["head"], lambda h, i: F.struct(h.alias("h"), l["tail"][i].alias("t"), l["relation_id"][i].alias("r"), F.coalesce(F.get(l["evidence"], i), F.array().cast("array<int>")).alias("evidence")))
    g = _clusters(docs).where("labels is not null").select("document_id", "named", F.posexplode(zipped).alias("i", "l")).where("l.h is not null and l.t is not null")
    at = lambda c: F.try_element_at("named", c + 1)
    name = lambda c: F.coalesce(at(c)["names"][0], F.concat(F.lit("#"), c))
    key = lambda c: F.concat(F.col("document_id"), F.lit("::e"), at(c)["i"])
    return g.select("document_id", F.concat(F.col("document_id"), F.lit("::g"), "i").alias("gold_edge_id"), key(F.col("l.h")).alias("head_entity_id"), key(F.col("l.t")).alias("tail_entity_id"), name(F.col("l.h")).alias("head_name"), name(F.col("l.t")).alias("tail_name"), F.col("l.r").alias("relation_base"), F.col("l.evidence").alias("evidence"))


def _examples(rows: DataFrame, make) -> DataFrame:
    """``make`` (a row as a dict to an example or None) for each document; what a document needs is in its row."""
    arrow = to_arrow_schema(StructType.fromDDL("idx long, " + EXAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [{"idx": r["idx"], **x} for r in batch.to_pylist() if (x := make(r)) is not None]
            if made:
                yield pa.RecordBatch.from_pylist(made, arrow)

    return rows.mapInArrow(run, "idx long, " + EXAMPLE)


def _columns(found: list[tuple[int, int, str, list[int]]]) -> dict:
    head, tail, relation, evidence = zip(*found, strict=True) if found else ((),) * 4
    return {"head": list(head), "tail": list(tail), "relation_id": list(relation), "relation_text": list(relation), "evidence": list(evidence)}


def span_clusters(sentences: list[list[str]], ner: list, clusters: list) -> tuple[list[list[dict]], dict[tuple[int, int], int]]:
    """Clusters of mentions, and the cluster of each span of tokens (counted over the document).

    Coreference clusters come first, then typed mentions in none of them, each alone. A cluster's type is the most frequent
    of its mentions' types other than Generic, of equally frequent ones the first; without any type it is Entity.
    """
    ends = list(accumulate(map(len, sentences)))
    typed = [(int(m[0]), int(m[1]), str(m[2])) for of in ner for m in of if len(m) > 2]
    kind = {(a, b): t for a, b, t in typed}
    spans = [[(int(x[0]), int(x[1])) for x in c] for c in clusters if c]
    place = {span: i for i, c in enumerate(spans) for span in c}
    types = [[kind[x] for x in c if x in kind] for c in spans]
    for a, b, t in typed:
        if (a, b) not in place:
            place[a, b] = len(spans)
            spans.append([(a, b)])
            types.append([t])

    def mention(a: int, b: int, t: str) -> dict:
        sid = bisect_right(ends, a) if 0 <= a < (ends[-1] if ends else 0) else max(len(sentences) - 1, 0)
        words, first = (sentences[sid] if sentences else []), (ends[sid - 1] if sid else 0)
        return {"name": " ".join(words[a - first : min(b - first, len(words) - 1) + 1]), "type": t, "sent_id": sid, "pos": [a - first, b - first + 1]}

    chosen = []
    for of in types:
        counts = Counter(t for t in of if t != "Generic") or Counter(of)
        chosen.append(counts.most_common(1)[0][0] if counts else "Entity")
    return [[mention(a, b, t) for a, b in c] for c, t in zip(spans, chosen, strict=True)], place


def read_scierc(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(idx, title, sents, vertexSet, labels) from JSON lines of (doc_key, sentences, ner, relations, clusters)."""
    schema = "doc_key string, sentences array<array<string>>, ner array<array<array<string>>>, relations array<array<array<string>>>, clusters array<array<array<int>>>"

    def make(r: dict) -> dict:
        sentences = r["sentences"] or []
        vertices, place = span_clusters(sentences, r["ner"] or [], r["clusters"] or [])
        found = []
        for sid, of in enumerate(r["relations"] or []):
            for x in of:
                h, t = (place.get((int(x[k]), int(x[k + 1]))) if len(x) > 4 else None for k in (0, 2))
                if h is not None and t is not None and h != t:
                    found.append((h, t, str(x[4]), [sid]))
        return {"title": r["doc_key"] or f"scierc_{r['idx']}", "sents": sentences, "vertexSet": vertices, "labels": _columns(found)}

    return _examples(numbered(spark.read.schema(schema).json(path), limit), make)


def read_cdr(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(idx, title, sents, vertexSet, labels) from PubTator blocks: mentions grouped by concept id, CID relations between groups.

    A mention with several ids is in each of their groups, one without is in none. A relation's evidence is the first five
    sentences with a mention of either group. A document without sentences is left out.
    """
    from driftloom.functions import text

    docs = numbered(read_pubtator(spark, path), limit).withColumn("_text", F.concat_ws(" ", "title", "abstract"))
    cut = docs.withColumn("_s", text.sentences(F.col("_text"))).withColumn("_t", F.transform("_s", lambda s: text.tokens_with_places(s["text"])))

    def make(r: dict) -> dict | None:
        if not r["_s"]:
            return None
        groups: dict[str, list[dict]] = {}
        for m in r["mentions"]:
            sid = next((i for i, s in enumerate(r["_s"]) if s["start"] <= m["start"] < s["stop"]), len(r["_s"]) - 1)
            at = r["_s"][sid]["start"]
            touched = [k for k, t in enumerate(r["_t"][sid]) if t["stop"] > m["start"] - at and t["start"] < m["stop"] - at]
            for concept in dict.fromkeys(m["mesh"]) if touched else ():
                groups.setdefault(concept, []).append({"name": m["text"], "type": m["type"], "sent_id": sid, "pos": [touched[0], touched[-1] + 1]})
        place, found = {c: i for i, c in enumerate(groups)}, []
        for x in r["relations"]:
            h, t = place.get(x["head"]), place.get(x["tail"])
            if h is not None and t is not None and h != t:
                found.append((h, t, "CID", sorted({m["sent_id"] for m in groups[x["head"]] + groups[x["tail"]]})[:5]))
        return {"title": r["pmid"] or f"cdr_{r['idx']}", "sents": [[t["token"] for t in of] for of in r["_t"]], "vertexSet": list(groups.values()), "labels": _columns(found)}

    return _examples(cut, make)


def read_pubtator(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract, mentions, relations) from blocks of lines."""
    lines = F.split(F.trim("value"), "\n")
    text = lambda mark: F.regexp_extract("value", rf"(?m)^\d+\|{mark}\|(.*)$", 1)
    rows = F.transform(F.filter(lines, lambda x: x.contains("\t")), lambda x: F.split(x, "\t"))
    mention = lambda r: F.struct(r[1].cast("int").alias("start"), r[2].cast("int").alias("stop"), r[3].alias("text"), r[4].alias("type"), F.filter(F.split(r[5], r"\|"), lambda m: m != "-1").alias("mesh"))
    relation = lambda r: F.struct(r[1].alias("kind"), r[2].alias("head"), r[3].alias("tail"))
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return raw.select(F.regexp_extract("value", r"^\s*(\d+)\|", 1).alias("pmid"), text("t").alias("title"), text("a").alias("abstract"), F.transform(F.filter(rows, lambda r: F.size(r) == 6), mention).alias("mentions"), F.transform(F.filter(rows, lambda r: F.size(r) == 4), relation).alias("relations"))


def mesh_clusters(docs: DataFrame) -> DataFrame:
    """(pmid, mesh, names, first): mentions grouped by each of their concept ids."""
    m = docs.select("pmid", F.explode("mentions").alias("m")).select("pmid", "m.*", F.explode("m.mesh").alias("id"))
    return m.groupBy("pmid", F.col("id").alias("mesh")).agg(F.array_sort(F.collect_set("text")).alias("names"), F.min("start").alias("first"))


def read_checkpoint(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """JSON lines where the last record of a key counts: in the order of a log's batches, or of plain files, then of place."""
    return log.read_latest(spark, path, schema, keys)


def read_yaml(path: str) -> dict:
    """A configuration file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def append_checkpoint(records: DataFrame, path: str) -> int:
    """Add records to a JSON lines checkpoint, as a batch after all others; what is there stays as it is."""
    return log.append(records, path)


def fingerprint(path: str) -> dict:
    """Bytes that make up a SQLite database: digest and size of the file, and the size of its write-ahead log."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    log = f"{path}-wal"
    return {"sha256": digest.hexdigest(), "bytes": os.path.getsize(path), "log_bytes": os.path.getsize(log) if os.path.exists(log) else 0}


class unchanged:
    """A block in which a SQLite database must stay as it is: no pages in its log before or after, and the same bytes."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __enter__(self) -> dict:
        self.before = fingerprint(self.path)
        if self.before["log_bytes"]:
            raise RuntimeError(f"{self.path} has a log that is not written back; checkpoint it first")
        return self.before

    def __exit__(self, kind, value, trace) -> None:
        after = fingerprint(self.path)
        if kind is None and after["log_bytes"]:
            raise RuntimeError(f"{self.path} has a log that is not written back; checkpoint it first")
        if kind is None and (after["sha256"], after["bytes"]) != (self.before["sha256"], self.before["bytes"]):
            raise RuntimeError(f"{self.path} changed while it was read")


def snapshot(spark: SparkSession, path: str) -> tuple[str, dict]:
    """A consistent copy of a SQLite database in the shared folder, and its fingerprint; read that, and all partitions see one state.

    The copy is made by SQLite's backup, which holds a read transaction, so writers may go on meanwhile and pages in a log
    are in it. The shared folder must be one that workers reach as files.
    """
    folder = re.sub(r"^file:/+", "/", shared_dir(spark))
    if not folder.startswith("/"):
        raise ValueError(f"SQLite reads files, and {folder} is none that it could open")
    os.makedirs(f"{folder}/driftloom", exist_ok=True)
    copy = f"{folder}/driftloom/snapshot-{uuid.uuid4().hex}.db"
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as there, closing(sqlite3.connect(f"{copy}.part")) as here:
        there.backup(here)
    os.replace(f"{copy}.part", copy)
    return copy, fingerprint(copy)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")`` with options path, table and key ranges of rowid; the file must be reachable by the workers."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "long", "REAL": "double"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in con.execute(f"PRAGMA table_info({self.options['table']})"))

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.columns, self.parts = options["path"], options["table"], schema.fieldNames(), int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            try:
                low, high = con.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.table}").fetchone()
            except sqlite3.OperationalError as e:
                if "rowid" not in str(e):
                    raise
                return [InputPartition(None)]  # a table WITHOUT ROWID is read in one piece
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((lo, min(lo + step, high + 1))) for lo in range(low, high + 1, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        if partition.value is None:
            with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
                yield from con.execute(f"SELECT {names} FROM {self.table}")
            return
        lo, hi = partition.value
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(f"SELECT {names} FROM {self.table} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (lo, hi))


def write_manifest(path: str, content: dict) -> None:
    """A small JSON file, complete or absent; an existing one is an error."""
    if os.path.exists(path):
        raise FileExistsError(path)
    with open(f"{path}.part", "x", encoding="utf-8") as f:
        json.dump(content, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def write_upsert(new: DataFrame, path: str, keys: list[str], to: str) -> None:
    """The table at ``path`` with rows of ``new`` in place of those with their keys, written at ``to``."""
    from driftloom.operators.lineage import upsert

    upsert(new.sparkSession.read.parquet(path), new, keys).write.parquet(to)


def read_registered(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A JSON artifact whose bytes have the registered digest; another digest raises."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()  # one file
    if [f.d for f in found] != [sha256]:
        raise ValueError(f"{path} is not the registered artifact")
    return spark.read.option("multiLine", "true").json(path)


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A summary as ``path``.json and as a Markdown table ``path``.md, rows in order of their columns; for tables of a few rows."""
    found = [r.asDict(recursive=True) for r in rows.orderBy(*rows.columns).collect()]
    write_manifest(f"{path}.json", {"title": title, "rows": found})
    shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *("| " + " | ".join(shown(r[c]) for c in rows.columns) + " |" for r in found)]
    with open(f"{path}.md", "x", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
