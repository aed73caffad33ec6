"""A caller's model over the rows that a cache lacks: retried, journalled, and committed once."""

from __future__ import annotations

import hashlib
import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.operators.ledger import incremental
from panelframe.operators.tables import shared_folder
from panelframe.sources import files


class Transient(Exception):
    """Raised by a model for a fault that may pass: the rows are asked for again."""


def _asked(model: Callable, rows: pd.DataFrame, retries: int, wait: float) -> tuple[pd.DataFrame | None, str | None, int]:
    """(answers, error, attempts): again after a fault that may pass, each time after twice the wait."""
    for attempt in range(1, retries + 2):
        try:
            return model(rows), None, attempt
        except Transient as e:
            error = str(e)
            if attempt <= retries:
                time.sleep(wait * 2 ** (attempt - 1))
    return None, error, retries + 1


def recomputed(wanted: DataFrame, cache: DataFrame, keys: list[str], model: Callable[[pd.DataFrame], pd.DataFrame], answer: T.StructType, journal: str | None = None, rows: int = 64, retries: int = 3, wait: float = 0.5) -> DataFrame:
    """(keys, hash, answer's columns, origin, error, attempts) of every wanted row.

    wanted(keys, hash, inputs...), cache(keys, hash, answer's columns).  A cached row of equal keys and hash is reused
    (origin cache); the others go to model(rows) -> one row of answers for each, in order, in slices of `rows` rows.
    A Transient fault is tried again, with growing waits; rows of a slice that never came through have an error and
    null answers, and any other fault fails the task.

    Finished slices are kept in the journal, a folder of the shared store, by the keys, hashes and place of their
    rows: a task that is lost, or a job that is run again with the same journal, asks for none of them again.
    Without a journal, a new one in spark.checkpoint.dir is used.  Wanted rows are dealt by their keys to a fixed
    number of tasks, where the cached ones go, and sorted: whoever runs again gets the same slices.

    Null keys match no cached row; equal rows are asked for each; no wanted rows give none.
    """
    spark = wanted.sparkSession
    reused, _ = incremental(wanted, cache, keys)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    missing = wanted.repartition(tasks, *keys, "hash").join(cache.select(*keys, "hash").distinct(), [*keys, "hash"], "left_anti").sortWithinPartitions(*keys, "hash")
    folder = (journal or f"{shared_folder(spark)}/model-journal-{hashlib.sha1(str(time.time_ns()).encode()).hexdigest()}").rstrip("/")
    names = [f.name for f in answer.fields]
    out = T.StructType([*(missing.schema[k] for k in [*keys, "hash"]), *answer.fields, T.StructField("origin", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = files.opened(folder)
        for pdf in frames:
            for k in range(0, len(pdf), rows):
                part = pdf.iloc[k : k + rows].reset_index(drop=True)
                path = f"{base}/{hashlib.sha256(pickle.dumps([tuple(map(repr, r)) for r in part[[*keys, 'hash']].itertuples(index=False)])).hexdigest()}"
                kept = files.read(fs, path)
                if kept is not None:
                    yield pickle.loads(kept)
                    continue
                answers, error, attempts = _asked(model, part, retries, wait)
                made = part[[*keys, "hash"]].copy()
                for n in names:
                    made[n] = answers[n].to_numpy() if answers is not None else None
                made["origin"], made["error"], made["attempts"] = "model", error, attempts
                if error is None:
                    files.put(fs, path, pickle.dumps(made))
                yield made

    new = missing.mapInPandas(ask, out)
    old = reused.select(*keys, "hash", *names, F.lit("cache").alias("origin"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    return old.unionByName(new)


def committed(results: DataFrame, path: str, run: str) -> DataFrame:
    """The cache at path after this run's answers are in it: each run has a folder of its own, which it writes over if it comes again."""
    spark = results.sparkSession
    fresh = results.where("origin = 'model' and error is null").drop("origin", "error", "attempts")
    fresh.write.mode("overwrite").parquet(f"{path}/run={run}")
    return spark.read.parquet(path).drop("run")


def canned(missing: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """missing with the answers of an earlier run in place of a model: the newest of each key and hash has to be there once."""
    return missing.join(answers, [*keys, "hash"], "left")
