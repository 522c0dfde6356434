"""Registry of fitted models: each is addressed by a fingerprint
of its input and parameters, published whole under that name, and listed in an
index.  Whoever asks for a model that is there loads it; only the first fits it."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.session import ensure_checkpoint_dir


def input_fingerprint(df: DataFrame) -> str:
    """Names the files a table is read from: path, size and time of change of each, in any order.  Reads no column."""
    m = F.col("_metadata")
    files = df.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t")).distinct()
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "p", "s", "t").cast("decimal(38,0)"))
    n, a, b = files.agg(F.count("*"), h("a"), h("b")).first()
    return f"{n}-{a}-{b}"


def address(inputs: list[str], params: dict) -> str:
    return hashlib.sha256(json.dumps([sorted(inputs), params], sort_keys=True, default=str).encode()).hexdigest()[:32]


class ModelRegistry:
    """Models below ``base`` (default: a folder of the shared checkpoint folder):
    ``models/<address>`` holds the pipeline and its metrics, ``index/address=...`` a record."""

    def __init__(self, spark, base: str | None = None):
        self.spark = spark
        self.base = (base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-registry").rstrip("/")

    def _path(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{place}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, at: str) -> bool:
        path, fs = self._path(f"models/{at}")
        return fs.exists(path)

    def publish(self, at: str, name: str, model: PipelineModel, metrics: dict, params: dict) -> None:
        """Writes everything under a name of its own, then renames it: readers see a
        whole model or none.  If another run published the same address first, its
        model stays and this one goes."""
        draft, fs = self._path(f"drafts/{uuid.uuid4().hex}")
        model.write().save(f"{draft.toString()}/pipeline")
        self.spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double").coalesce(1).write.parquet(f"{draft.toString()}/metrics")
        final, _ = self._path(f"models/{at}")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, True)
        nested, _ = self._path(f"models/{at}/{draft.getName()}")
        if fs.exists(nested):  # a rename into a folder that another run had just made
            fs.delete(nested, True)
        if not self.has(at):
            raise OSError(f"model {at} could not be published")
        record = self.spark.createDataFrame([(name, json.dumps(params, sort_keys=True, default=str), at)], "name string, params string, address string")
        record.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("address").parquet(f"{self.base}/index")

    def load(self, at: str) -> PipelineModel:
        return PipelineModel.load(f"{self.base}/models/{at}/pipeline")

    def metrics(self, at: str) -> DataFrame:
        return self.spark.read.schema("metric string, value double").parquet(f"{self.base}/models/{at}/metrics")

    def index(self) -> DataFrame:
        return self.spark.read.schema("name string, params string, address string").parquet(f"{self.base}/index")

    def get(self, name: str, inputs: list[DataFrame], params: dict, fit) -> str:
        """The address of the model ``name`` of these inputs and parameters;
        ``fit() -> (pipeline, metrics)`` runs only if it isn't there."""
        at = address([input_fingerprint(d) for d in inputs], {"name": name, **params})
        if not self.has(at):
            model, metrics = fit()
            self.publish(at, name, model, metrics, params)
        return at
