"""Corpus lines and their sidecar, split maps, result documents, logs, measurements and configurations."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import Refused, refuse_if_any, require_unique

#: Fixed value: fields of a corpus line, in the order they are written.
FIELDS = ("doc_id", "text", "domain", "lang", "source", "n_tokens_ref", "split", "shard_id")
CORPUS = "doc_id long, text string, domain string, lang string, source string, n_tokens_ref long, split string, shard_id int"
FAMILY = "map<string,double>"
CELL = f"struct<layer:int,model_layer:int,status:string,reason:string,metrics:struct<split:string,n_rows:long,n_slots:long,family_a:{FAMILY},family_b:{FAMILY}>>"
RESULT = f"model string, feature string, run_config_sha256 string, logit_tensor_used string, n_moe_layers int, n_experts int, top_k int, layers map<string,{CELL}>"


def write_corpus(docs: DataFrame, path: str) -> None:
    """JSON lines, a folder per shard; every character beyond ASCII is escaped, fields in the fixed order."""
    line = F.to_json(F.struct(*[F.col(c) for c in FIELDS]), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
    docs.select(F.col("shard_id").alias("shard"), line.alias("value")).write.mode("errorifexists").partitionBy("shard").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus lines; blank lines are passed over, a missing or malformed field is refused."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value")
    docs = lines.select(F.from_json("value", CORPUS, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    null = F.lit(False)
    for c in FIELDS:
        null = null | F.col(c).isNull()
    refuse_if_any(docs.where(null).select("doc_id"), "a corpus line lacks a field")
    return docs


def doc_splits(docs: DataFrame) -> DataFrame:
    """``doc_id, split``; a repeated or null id, or a null split, is refused."""
    require_unique(docs, "doc_id")
    refuse_if_any(docs.where("split IS NULL").select("doc_id"), "no split")
    return docs.select("doc_id", "split")


def read_results(spark: SparkSession, path: str, require_uniform_config: bool = True) -> DataFrame:
    """Cells of result documents ``*__*.json``, one row per layer, after checking that geometry and
    selection tensor agree per model, the run configuration over all, and the stored bound with its parts."""
    docs = spark.read.schema(RESULT).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*__*.json").json(path)
    same = docs.groupBy("model").agg(*[F.countDistinct(c).alias(c) for c in ("n_moe_layers", "n_experts", "top_k", "logit_tensor_used")])
    refuse_if_any(same.where("n_moe_layers > 1 OR n_experts > 1 OR top_k > 1 OR logit_tensor_used > 1"), "documents of a model disagree")
    if require_uniform_config and docs.select("run_config_sha256").distinct().count() > 1:
        raise Refused("documents come from different run configurations")
    cells = docs.select("model", "feature", "run_config_sha256", "logit_tensor_used", "n_moe_layers", "n_experts", "top_k", F.explode("layers").alias("key", "cell"))
    cells = cells.select("*", F.col("key").cast("int").alias("layer"), "cell.model_layer", "cell.status", "cell.reason", "cell.metrics").drop("key", "cell")
    b = lambda k: F.try_element_at("metrics.family_b", F.lit(k))
    off = F.abs(b("entropy_bits") - b("cross_entropy_bits") - b("mi_bits")) > 1e-9
    refuse_if_any(cells.where(off).select("model", "feature", "layer"), "stored bound is not entropy minus cross-entropy")
    return cells


def metric(cells: DataFrame, family: str, key: Column) -> Column:
    """A metric of a cell by key; null if the cell lacks it."""
    return F.try_element_at(F.col(f"metrics.{family}"), key)


def parse_nodes(lines: DataFrame) -> DataFrame:
    """``name, base, il, dtype, op, shape, sources`` of the node lines of a callback log ``(value)``;
    other lines are passed over."""
    pattern = r"^common_debug_cb_eval:\s+(\S+)\s+=\s+\(([^)]*)\)\s+([^\s(]+)\((.*)\)\s+=\s+\{([^}]*)\}\s*$"
    v = F.trim("value")
    part = lambda k: F.regexp_extract(v, pattern, k)
    out = lines.where(v.rlike(pattern)).select(part(1).alias("name"), F.trim(part(2)).alias("dtype"), part(3).alias("op"), part(5).alias("ne"), part(4).alias("srcs"))
    shape = F.transform(F.split("ne", ","), lambda x: F.trim(x).cast("int"))
    sources = F.regexp_extract_all("srcs", F.lit(r"([^\s,{}]+)\s*\{"), F.lit(1))
    layer = F.regexp_extract("name", r"^(.+?)-(\d+)$", 2)
    return out.select("name", F.regexp_replace("name", r"-\d+$", "").alias("base"), F.when(layer != "", layer.cast("int")).alias("il"), "dtype", "op", shape.alias("shape"), sources.alias("sources"))


def node_counts(nodes: DataFrame, bases: list[str], n_layers: int | None = None) -> DataFrame:
    """``il, base, n`` for every layer and wanted node name: exactly one each is right. Layers are those
    expected, 0 to ``n_layers`` - 1, and those seen, so that one without any node is reported."""
    layers = nodes.where("il IS NOT NULL").select("il")
    if n_layers:
        layers = layers.unionByName(nodes.sparkSession.range(n_layers).select(F.col("id").cast("int").alias("il")))
    spine = layers.distinct().withColumn("base", F.explode(F.array(*map(F.lit, bases))))
    return spine.join(nodes.groupBy("il", "base").agg(F.count("*").alias("n")), ["il", "base"], "left").select("il", "base", F.coalesce("n", F.lit(0)).alias("n"))


def parse_bench(texts: DataFrame, commit: str | None = None) -> DataFrame:
    """Rows of a throughput benchmark's JSON array ``(value)`` without generation rows; another build's
    rows are refused, as is a result without prompt rows."""
    schema = "array<struct<model_filename:string,n_prompt:int,n_gen:int,avg_ts:double,stddev_ts:double,n_gpu_layers:int,n_threads:int,n_batch:int,n_ubatch:int,build_commit:string>>"
    rows = texts.select(F.explode(F.from_json("value", schema, {"mode": "FAILFAST"})).alias("r")).select("r.*").where("coalesce(n_gen, 0) = 0")
    if commit:
        other = ~F.lit(commit).startswith(F.col("build_commit")) & ~F.col("build_commit").startswith(F.lit(commit))
        refuse_if_any(rows.where((F.col("build_commit") != "") & other).select("build_commit"), f"measured on another build than {commit}")
    if not rows.take(1):
        raise Refused("no prompt rows")
    return rows


def canonical_hash(payload: dict) -> str:
    """SHA-256 of a configuration: sorted keys, no spaces, no NaN."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def parse_shard_ids(text: str) -> list[int]:
    """Shard numbers from ``0-3,7``."""
    out: set[int] = set()
    for part in text.split(","):
        if not re.fullmatch(r"\s*\d+\s*(-\s*\d+\s*)?", part):
            raise Refused(f"not a shard range: {part!r}")
        low, _, high = part.partition("-")
        out.update(range(int(low), int(high or low) + 1))
    return sorted(out)


def blake2b(text: Column, bits: int = 64) -> Column:
    """Hex digest of a text by BLAKE2b of 64 or 128 bits, which Spark has no function for."""
    size = bits // 8

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else hashlib.blake2b(t.encode(), digest_size=size).hexdigest() for t in texts.to_pylist()], pa.string())

    return run(text)


def expanded(template: Column, number: Column) -> Column:
    """A name template with its one ``%d`` replaced; null where it has none or several."""
    once = F.length(template) - F.length(F.replace(template, F.lit("%d"), F.lit(""))) == 2
    return F.when(once, F.replace(template, F.lit("%d"), number.cast("string")))


def write_sidecar(spark: SparkSession, docs: DataFrame, path: str) -> None:
    """A one-line JSON beside a corpus: documents, tokens and shards, tokens by split and domain, and a
    digest of ids and texts that does not depend on the order of the rows."""
    line = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256)
    part = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    total = docs.agg(F.count("*").alias("n_docs"), F.sum("n_tokens_ref").alias("n_tokens_ref"), F.countDistinct("shard_id").alias("n_shards"), F.sum(part).cast("string").alias("content_sum"))
    groups = {c: {r[c]: r["n"] for r in docs.groupBy(c).agg(F.sum("n_tokens_ref").alias("n")).orderBy(c).collect()} for c in ("split", "domain")}
    row = total.first().asDict() | {f"tokens_by_{c}": v for c, v in groups.items()}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def _replace(spark: SparkSession, uri: str, data: bytes) -> None:
    """Writes a file whole or not at all: to a name of its own first, which then takes the old one's place."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(uri)
    part = jvm.org.apache.hadoop.fs.Path(f"{uri}.{uuid.uuid4().hex}.part")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else target.makeQualified(jvm.java.net.URI("file:///"), jvm.org.apache.hadoop.fs.Path("/")).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(part, True)
    out.write(bytearray(data))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, target, options)


def write_result(spark: SparkSession, folder: str, document: dict) -> str:
    """Writes the result document of a (model, feature) as ``model__feature.json`` in place of an older one
    and returns its path. NaN and infinity are refused."""
    uri = f"{folder.rstrip('/')}/{document['model']}__{document['feature']}.json"
    _replace(spark, uri, json.dumps(document, sort_keys=True, indent=1, allow_nan=False).encode())
    return uri


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows to a log of CSV files with a header each; a log with other columns is refused."""
    spark = rows.sparkSession
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(old):
        there = spark.read.option("header", True).csv(path).columns
        if there and there != rows.columns:
            raise Refused(f"the log has the columns {there}, not {rows.columns}")
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log or table of CSV files."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON configuration file; one that is no mapping is refused."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise Refused("reading YAML needs the yaml package; JSON is read without it") from e
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise Refused("a configuration is a mapping")
    return found


def model_rows(spark: SparkSession, config: dict) -> DataFrame:
    """``model, n_moe_layers, n_experts, top_k, aux_loss`` from a configuration's ``models`` mapping."""
    names = ("n_moe_layers", "n_experts", "top_k")
    rows = []
    for model, meta in sorted(config.get("models", {}).items()):
        if lost := [n for n in names if meta.get(n) is None]:
            raise Refused(f"{model} lacks {', '.join(lost)}")
        rows.append((model, *(int(meta[n]) for n in names), None if meta.get("aux_loss") is None else float(meta["aux_loss"])))
    return spark.createDataFrame(rows, "model string, n_moe_layers int, n_experts int, top_k int, aux_loss double")
