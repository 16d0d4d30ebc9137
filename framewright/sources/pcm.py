"""PCM16 WAV files as rows of samples. One file is one utterance and is decoded by one task."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.sources.catalog import path_parts

SCALES = {"pitch": 32767.0, "train": 32768.0}


def decode_wav(files: DataFrame, content: str, keep: list[str], use: str = "train") -> DataFrame:
    """keep, rate, samples: mono 16-bit samples scaled by 1/32768 for training or 1/32767 for pitch."""
    scale = SCALES[use]

    def run(batches):
        for pdf in batches:
            rates, samples = [], []
            for raw in pdf[content]:
                with wave.open(io.BytesIO(raw)) as w:
                    if w.getsampwidth() != 2 or w.getnchannels() != 1:
                        raise ValueError("only mono 16-bit PCM is supported")
                    rates.append(w.getframerate())
                    samples.append((np.frombuffer(w.readframes(w.getnframes()), "<i2") / scale).astype(np.float32))
            yield pdf[keep].assign(rate=rates, samples=samples)

    kept = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keep)
    return files.select(*keep, content).mapInPandas(run, f"{kept}, rate int, samples array<float>")


def encode_wav(rows: DataFrame, samples: str, keep: list[str], rate: int) -> DataFrame:
    """keep, content: an array of 16-bit levels as WAV bytes."""

    def run(batches):
        for pdf in batches:
            out = []
            for levels in pdf[samples]:
                buffer = io.BytesIO()
                with wave.open(buffer, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(rate)
                    w.writeframes(np.asarray(levels, dtype="<i2").tobytes())
                out.append(buffer.getvalue())
            yield pdf[keep].assign(content=out)

    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, samples).mapInPandas(run, f"{kept}, content binary")


def read_corpus(spark: SparkSession, root: str, use: str = "train") -> DataFrame:
    """speaker, utt, rate, samples of every `root/<speaker>/<utt>.wav`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(f"{root}/*")
    named = files.select(*path_parts(F.col("path")), "content")
    return decode_wav(named, "content", ["speaker", "utt"], use)


def read_npy(spark: SparkSession, root: str, suffix: str = ".npy") -> DataFrame:
    """speaker, utt, frame, v of every `.npy` feature matrix under `root/<speaker>/`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(f"{root}/*")
    named = files.select(*path_parts(F.col("path"), suffix), "content")

    def run(batches):
        for pdf in batches:
            for speaker, utt, raw in pdf.itertuples(index=False):
                matrix = np.atleast_2d(np.load(io.BytesIO(raw), allow_pickle=False)).astype(np.float32)
                yield pd.DataFrame({"speaker": speaker, "utt": utt, "frame": np.arange(len(matrix)), "v": list(matrix)})

    return named.mapInPandas(run, "speaker string, utt string, frame bigint, v array<float>")
