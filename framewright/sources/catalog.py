"""Finding corpus files: (speaker, utterance) listings and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def path_parts(path: Column, suffix: str = ".wav") -> list[Column]:
    """speaker and utterance of `…/speaker/utterance<suffix>`."""
    leaf = F.regexp_extract(path, r"([^/]+)$", 1)
    return [
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("speaker"),
        F.substring(leaf, F.lit(1), F.length(leaf) - len(suffix)).alias("utt"),
    ]


def scan_corpus(spark: SparkSession, root: str, suffix: str = ".wav") -> DataFrame:
    """path, speaker, utt of every matching file in `root`, whose name is then the speaker, or one level below; contents are not read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(root)
    depth = F.size(F.split(F.substring("path", len(whole) + 2, 1 << 20), "/"))
    return files.where(depth <= 2).select("path", *path_parts(F.col("path"), suffix))


def list_artifacts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Every file under `root` with the suffix, at any depth."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True)
    return files.load(root).select("path", "length", "modificationTime")


def pending(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(outputs.select(*keys), keys, "left_anti")


def speaker_list(rows: DataFrame, only: list | None = None, spk: str = "spk") -> DataFrame:
    """Distinct speakers, or those of a given list that exist."""
    picked = rows.select(spk) if only is None else rows.select(spk).where(F.col(spk).isin(only))
    return picked.distinct()
