"""A sweep over features that can be taken up again: one result document per (model, feature)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..sources.documents import write_result
from .checks import Refused

#: Figures of a cell by family: overlap with the true set, and information.
FAMILY_A = ("set_agreement", "exact_match", "recall_2k", "recall_4k")
FAMILY_B = ("entropy_bits", "cross_entropy_bits", "mi_bits", "ratio", "ce_normalized", "entropy_normalized")


def done(spark: SparkSession, folder: str, model: Mapping) -> set[str]:
    """Features of the model whose document in the folder has the same run configuration and a cell for
    every layer. A document of another configuration is refused, so that two runs never mix."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
    if not any(n.startswith(f"{model['model']}__") and n.endswith(".json") for n in names):
        return set()
    fields = "model string, feature string, run_config_sha256 string, layers map<string,struct<status:string>>"
    docs = spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", f"{model['model']}__*.json").json(folder).collect()
    if other := [d["feature"] for d in docs if d["run_config_sha256"] != model["run_config_sha256"]]:
        raise Refused(f"{', '.join(sorted(other))}: results of another run configuration")
    return {d["feature"] for d in docs if len(d["layers"]) == model["n_moe_layers"]}


def sweep(spark: SparkSession, folder: str, model: Mapping, features: Mapping[str, Callable[[], DataFrame]], reasons: Mapping[str, Mapping[int, str]] | None = None) -> list[str]:
    """Evaluates the features that ``folder`` has no document of, writes each document when its feature is
    done, and returns their names.

    ``model`` holds model, run_config_sha256, logit_tensor_used, n_moe_layers, n_experts, top_k; a feature
    gives ``layer, n_rows`` and figures by layer; recalls are stored by the number of places. A layer without a row is ``skipped`` with its reason.
    """
    have, written = done(spark, folder, model), []
    keys = {f"recall_{m}k": f"recall@{m * model['top_k']}" for m in (2, 4)}
    for feature, make in features.items():
        if feature in have:
            continue
        rows = {r["layer"]: r.asDict() for r in make().collect()}
        layers = {}
        for layer in range(model["n_moe_layers"]):
            cell: dict = {"layer": layer, "model_layer": layer, "status": "ok" if layer in rows else "skipped"}
            if layer in rows:
                families = ({keys.get(k, k): float(rows[layer][k]) for k in names if rows[layer].get(k) is not None} for names in (FAMILY_A, FAMILY_B))
                cell["metrics"] = {"split": "test", "n_rows": rows[layer]["n_rows"], "n_slots": rows[layer]["n_rows"] * model["top_k"], **dict(zip(("family_a", "family_b"), families))}
            else:
                cell["reason"] = (reasons or {}).get(feature, {}).get(layer, "no rows")
            layers[str(layer)] = cell
        write_result(spark, folder, dict(model) | {"feature": feature, "layers": layers})
        written.append(feature)
    return written
