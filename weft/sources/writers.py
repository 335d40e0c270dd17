"""Sinks: RDF syntaxes, snapshots of tables, embeddings and memories with manifests, reports, run tables, logs."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import names
from weft.functions import predicates as P
from weft.functions.text import slug
from weft.operators.tables import first_per

SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
PROPERTY = "http://www.w3.org/2002/07/owl#ObjectProperty"
VERSION = 1


def _escaped(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def iri(name: Column, base: str) -> Column:
    return F.when(name.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), name).otherwise(F.concat(F.lit(base), slug(name)))


def resolved(triples: DataFrame, base: str, declare: bool = True, labels: bool = False) -> DataFrame:
    """Distinct s, p, o (full IRIs, or a literal) and kind: hierarchy relations are rdfs:subClassOf, names without an IRI get one
    under base, other relations are declared, and names are given as labels where asked.
    """
    kind = F.col("kind") if "kind" in triples.columns else F.lit("iri")
    p = F.when(P.is_hierarchy(F.col("p")), F.lit(SUBCLASS)).otherwise(iri(F.col("p"), base))
    rows = triples.select(iri(F.col("s"), base).alias("s"), p.alias("p"), F.when(kind == "literal", F.col("o")).otherwise(iri(F.col("o"), base)).alias("o"), F.when(kind == "literal", "literal").otherwise("iri").alias("kind"))
    if declare:
        other = triples.where(~P.is_hierarchy(F.col("p"))).select(iri(F.col("p"), base).alias("s"), F.lit(TYPE).alias("p"), F.lit(PROPERTY).alias("o"), F.lit("iri").alias("kind"))
        rows = rows.unionByName(other)
    if labels:
        ends = triples.select(F.col("s").alias("x")).union(triples.where(kind != "literal").select("o")).where(~F.col("x").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"))
        rows = rows.unionByName(ends.select(iri(F.col("x"), base).alias("s"), F.lit(LABEL).alias("p"), F.col("x").alias("o"), F.lit("literal").alias("kind")))
    return rows.distinct()


def statements(triples: DataFrame, base: str, declare: bool = True, labels: bool = False) -> DataFrame:
    """resolved() as lines of N-Triples, which Turtle readers read too."""
    node = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    o = F.when(F.col("kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))).otherwise(node("o"))
    return resolved(triples, base, declare, labels).select(F.concat_ws(" ", node("s"), node("p"), o, F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, base: str = "urn:weft:", declare: bool = True) -> None:
    statements(triples, base, declare).write.mode("overwrite").text(path)


def _framed(lines: DataFrame, head: str, foot: str) -> DataFrame:
    """Lines with head before and foot after those of each partition, so that each file is a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, schema = True, None
        for batch in batches:
            schema = batch.schema
            if batch.num_rows:
                if first:
                    yield pa.record_batch([pa.array([head])], schema=batch.schema)
                first = False
                yield batch
        if not first and foot:
            yield pa.record_batch([pa.array([foot])], schema=schema)

    return lines.mapInArrow(run, "value string")


def write_turtle(triples: DataFrame, path: str, base: str = "urn:weft:", prefixes: Mapping[str, str] = names.NAMESPACES, declare: bool = True, labels: bool = False) -> None:
    """Turtle with prefixed names, each file with its prefixes."""
    short = lambda c: F.when(names.compacted(F.col(c), prefixes).rlike(r"^[A-Za-z][\w-]*:[A-Za-z_][\w-]*$"), names.compacted(F.col(c), prefixes)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    o = F.when(F.col("kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))).otherwise(short("o"))
    lines = resolved(triples, base, declare, labels).select(F.concat_ws(" ", short("s"), short("p"), o, F.lit(".")).alias("value"))
    _framed(lines, "\n".join(f"@prefix {p}: <{ns}> ." for p, ns in sorted(prefixes.items())), "").write.mode("overwrite").text(path)


def write_rdfxml(triples: DataFrame, path: str, base: str = "urn:weft:", declare: bool = True, labels: bool = False) -> None:
    """RDF/XML, a description for each statement (a subject may have any number); relations whose IRI has no XML name at its end are an error."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    local = F.regexp_extract("p", r"([A-Za-z_][\w.-]*)$", 1)
    space = F.substring(F.col("p"), F.lit(1), F.length("p") - F.length(local))
    named = F.when(local != "", local).otherwise(F.raise_error(F.concat(F.lit("no XML name in "), F.col("p"))))
    value = F.when(F.col("kind") == "literal", F.concat(F.lit(">"), safe(F.col("o")), F.lit("</x:"), named, F.lit(">"))).otherwise(F.concat(F.lit(' rdf:resource="'), safe(F.col("o")), F.lit('"/>')))
    line = F.concat(F.lit('<rdf:Description rdf:about="'), safe(F.col("s")), F.lit('"><x:'), named, F.lit(' xmlns:x="'), safe(space), F.lit('"'), value, F.lit("</rdf:Description>"))
    head = '<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
    _framed(resolved(triples, base, declare, labels).select(line.alias("value")), head, "</rdf:RDF>").write.mode("overwrite").text(path)


def write_rdf(triples: DataFrame, path: str, form: str = "turtle", **options) -> None:
    """In Turtle, N-Triples or RDF/XML."""
    writers = {"turtle": write_turtle, "ttl": write_turtle, "nt": write_ntriples, "xml": write_rdfxml, "rdf/xml": write_rdfxml}
    if form not in writers:
        raise ValueError(f"no writer for {form}")
    writers[form](triples, path, **options)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """check, value, status as CSV with a header."""
    report.select(F.col("check").alias("Check"), F.col("value").alias("Result"), F.col("status").alias("Status")).write.mode("overwrite").csv(path, header=True)


def wide_metrics(metrics: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keys, metric, value) as one row for each of keys, a column for each metric (at most the session's pivot limit), in order of name."""
    return metrics.groupBy(*keys).pivot("metric").agg(F.first("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(run, metric, value) as one wide CSV row for each run."""
    wide_metrics(metrics).orderBy("run").write.mode("overwrite").csv(path, header=True)


def markdown(rows: DataFrame) -> DataFrame:
    """rows as lines (n, value) of a Markdown table; the head first."""
    cells = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in rows.columns)), " | "), F.lit(" |"))
    head = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    top = rows.sparkSession.createDataFrame([(-2, head[0]), (-1, head[1])], "n long, value string")
    return top.unionByName(rows.select(F.monotonically_increasing_id().alias("n"), cells.alias("value")))


def save_runs(old: DataFrame | None, new: DataFrame, path: str) -> None:
    """Runs (run_id, created_at, ...), the newest of each id, into a path other than old's."""
    rows = new if old is None else old.unionByName(new)
    first_per(rows, ["run_id"], [F.desc("created_at")]).write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def log_records(spark: SparkSession, path: str) -> DataFrame:
    """A log's records in the order of their numbers."""
    return spark.read.parquet(path).orderBy("lsn")


def derived_from(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records that a record was directly made of."""
    rows = spark.read.parquet(path)
    return rows.join(rows.where(F.col("id") == record).select(F.explode("derived_from").alias("id")).distinct(), "id", "left_semi")


def _files(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = _files(spark, path)
    return files.exists(there)


def delete(spark: SparkSession, path: str) -> bool:
    files, there = _files(spark, path)
    return files.delete(there, True)


def _write_manifest(spark: SparkSession, folder: str, manifest: Mapping) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """What a folder says of itself; None if it is no snapshot, or was not written to its end."""
    if not exists(spark, f"{folder}/manifest/_SUCCESS"):
        return None
    return json.loads(spark.read.text(f"{folder}/manifest").first()[0])


def save_snapshot(tables: Mapping[str, DataFrame], folder: str, **about) -> None:
    """Tables as Parquet, then a manifest that names them: a snapshot without one is not complete. Plain tables need no pointers mended."""
    spark = next(iter(tables.values())).sparkSession
    delete(spark, f"{folder}/manifest")
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    _write_manifest(spark, folder, {"version": VERSION, "tables": sorted(tables), **about})


def load_snapshot(spark: SparkSession, folder: str, **expected) -> dict[str, DataFrame] | None:
    """The tables of a complete snapshot of this version whose manifest says what is expected; else None."""
    manifest = read_manifest(spark, folder)
    if manifest is None or manifest["version"] != VERSION or any(manifest.get(k) != v for k, v in expected.items()):
        return None
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}


def digest(triples: DataFrame) -> str:
    """128 bits that say which distinct triples an ontology has, in any order."""
    cell = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("s", "p", "o")))
    rows = triples.select("s", "p", "o").distinct().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(cell)).alias("a"), F.bit_xor(F.xxhash64(cell, F.lit(1))).alias("b")).first()
    return f"{rows.n}-{(rows.a or 0) & (1 << 64) - 1:016x}{(rows.b or 0) & (1 << 64) - 1:016x}"


def save_embeddings(vectors: DataFrame, folder: str, ontology: str, refine: bool = False, alpha: float = 0.5, model: str = "hashed") -> None:
    """vectors (id, graph, text, fused) of an ontology (its digest), and the settings that they depend on; a missing vector is an error."""
    missing = vectors.where("fused IS NULL OR graph IS NULL OR text IS NULL")
    if vectors.isEmpty() or not missing.isEmpty():
        raise ValueError("a class has no embeddings to save")
    save_snapshot({"embeddings": vectors}, folder, ontology=ontology, refine=refine, alpha=alpha, model=model)


def load_embeddings(spark: SparkSession, folder: str, ids: DataFrame, ontology: str, refine: bool = False, alpha: float = 0.5, model: str = "hashed") -> DataFrame | None:
    """The saved vectors, if they are of the same ontology, settings and ids (id); else None."""
    found = load_snapshot(spark, folder, ontology=ontology, refine=refine, alpha=alpha, model=model)
    if found is None:
        return None
    saved = found["embeddings"]
    same = ids.select("id").distinct().join(saved.select("id"), "id", "left_anti").isEmpty() and saved.join(ids.select("id"), "id", "left_anti").isEmpty()
    return saved if same else None


def clear_embeddings(spark: SparkSession, folders: list[str], ontology: str) -> list[str]:
    """Those of folders that hold embeddings of the ontology, after they were deleted."""
    gone = [f for f in folders if (read_manifest(spark, f) or {}).get("ontology") == ontology]
    return [f for f in gone if delete(spark, f)]


def save_memory(hot: DataFrame, short: DataFrame, long: DataFrame, folder: str) -> None:
    """The three tiers of an answer memory."""
    save_snapshot({"hot": hot, "short_term": short, "long_term": long}, folder, kind="memory")


def load_memory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tiers that were saved; none if nothing was."""
    return load_snapshot(spark, folder, kind="memory") or {}


def save_run_graph(thoughts: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges of runs (run_id, ..., expires: a timestamp or null) as items of one table, a folder for each run; runs that are written again are replaced."""
    item = lambda df, kind: df.select("run_id", F.lit(kind).alias("item"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*df.columns)).alias("body"), F.col("expires").cast("timestamp").alias("expires"))
    rows = item(thoughts, "NODE").unionByName(item(edges, "EDGE"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def load_run_graph(spark: SparkSession, path: str, run_id, nodes: str, edges: str, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (of these schemas) of a run that have not expired; only the run's folder is read."""
    rows = spark.read.parquet(path).where(F.col("run_id") == run_id)
    if now is not None:
        rows = rows.where(F.col("expires").isNull() | (F.col("expires") > F.lit(now).cast("timestamp")))
    read = lambda kind, schema: rows.where(F.col("item") == kind).select(F.from_json("body", schema).alias("x")).select("x.*")
    return read("NODE", nodes), read("EDGE", edges)


def save_trace(steps: DataFrame, folder: str, stamp: str) -> None:
    """An execution's steps under its time, and again as the latest."""
    for name in (stamp, "latest"):
        steps.write.mode("overwrite").json(f"{folder}/{name}")


def save_metrics(values: Mapping[str, float | int | str | None], spark: SparkSession, path: str) -> None:
    """Scalar metrics as one JSON row."""
    spark.createDataFrame([(json.dumps(dict(values), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
