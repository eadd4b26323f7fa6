"""Fitted models on shared storage under the hash of their content, and a seal of the final choice that evaluation must match."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession

from trailmix.operators.boosting import Ensemble
from trailmix.sources import files

SEAL = "evaluation_seal.json"


def canonical(content) -> str:
    """SHA-256 of JSON with sorted keys: equal content has equal ids, whatever the order in which it was put together."""
    return hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def save_model(spark: SparkSession, folder: str, name: str, model: Ensemble) -> dict[str, str]:
    """Write a model; its path within the folder and the hash of its text."""
    text = json.dumps(model.content(), sort_keys=True)
    path = f"models/{name}.json"
    files.write_text(spark, f"{folder}/{path}", text)
    return {"path": path, "sha256": hashlib.sha256(text.encode()).hexdigest()}


def seal(spark: SparkSession, folder: str, chosen: dict[str, dict[str, dict]], lineage: dict) -> str:
    """Fix the choice (group to objective to {path, sha256, ...}) before labels of the evaluation are seen; its id. A folder that is sealed to another choice refuses."""
    content = {"groups": chosen, "lineage": lineage, "evaluation_labels_consulted": False}
    text = json.dumps(content | {"seal_id": canonical(content)}, sort_keys=True)
    if files.names(spark, folder, SEAL):
        if files.read_text(spark, f"{folder}/{SEAL}") != text:
            raise ValueError("the final choice is already sealed to another experiment")
    else:
        files.write_text(spark, f"{folder}/{SEAL}", text)
    return canonical(content)


def opened(spark: SparkSession, folder: str, objectives: tuple[str, ...], lineage: dict) -> dict[str, dict[str, Ensemble]]:
    """The sealed models by group and objective; a seal or model file that was changed, or another lineage, is refused."""
    content = json.loads(files.read_text(spark, f"{folder}/{SEAL}"))
    told = content.pop("seal_id")
    if canonical(content) != told or content["evaluation_labels_consulted"] is not False:
        raise ValueError("the evaluation seal was changed")
    if content["lineage"] != lineage:
        raise ValueError("the data differ from those of the sealed experiment")
    out: dict[str, dict[str, Ensemble]] = {}
    for group, models in content["groups"].items():
        if set(models) != set(objectives):
            raise ValueError("a seal needs a model for every objective")
        for objective, entry in models.items():
            if ".." in entry["path"] or entry["path"].startswith("/"):
                raise ValueError("a sealed model lies outside its folder")
            text = files.read_text(spark, f"{folder}/{entry['path']}")
            if hashlib.sha256(text.encode()).hexdigest() != entry["sha256"]:
                raise ValueError("a sealed model was changed")
            out.setdefault(group, {})[objective] = Ensemble.read(json.loads(text))
    return out
