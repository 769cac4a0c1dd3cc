"""Model store (S12): fits that outlive the session and score without a refit.

A stored model is a folder with the tables ``coef``, ``ranef`` and ``fit`` and a one-row ``manifest``
(name, specification, terms, levels, moments, key), which is written last: a folder without it is no
model.  The key is a digest of the specification and of the rows it is fitted to (their number and two
order-free sums of hashes of the model's columns), so ``fitted`` refits exactly when either differs.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.operators.gram import Design, ModelSpec
from kairos.operators.mixed import MixedModel
from kairos.session import checkpoint_dir
from kairos.sources.sinks import load_model_tables, save_model_tables

TABLES = ("coef", "ranef", "fit")


class StoredModel:
    """A model read from its tables; scores, effect tables and series take it as they take a fresh fit."""

    def __init__(self, spark: SparkSession, path: str):
        row = spark.read.parquet(f"{path}/manifest").first()
        told = json.loads(row["manifest"])
        self.spark, self.path, self.key, self.name = spark, path, row["key"], row["name"]
        self.spec = ModelSpec(**told["spec"])
        self.q = self.spec.q()
        self.design = Design(self.spec, told["terms"], told["levels"],
                             {t: tuple(v) for t, v in told["moments"].items()}, told["dropped"])
        tables = load_model_tables(spark, path, TABLES)
        self.coef, self.ranef, self.fit = (tables[t] for t in TABLES)

    def coefficients(self) -> dict[str, dict[str, tuple[float, float]]]:
        """Stratum → term → (beta, se): as many as the strata of a mixed model."""
        out: dict = {}
        for r in self.coef.select("stratum", "term", "beta", "se").collect():
            out.setdefault(r["stratum"], {})[r["term"]] = (r["beta"], r["se"])
        return out


def model_key(df: DataFrame, spec: ModelSpec) -> str:
    """Digest of the specification and of the model's columns of ``df``, in one pass; row order is of no account."""
    cols = [spec.outcome, *spec.slopes, *spec.flags, *spec.numeric, *spec.factors, *spec.strata,
            *([spec.group] if spec.group else [])]
    h = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in dict.fromkeys(cols)])
    row = df.select(h.alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(20,0)")),
                                      F.sum(F.xxhash64("h").cast("decimal(20,0)"))).first()
    text = json.dumps([asdict(spec), [str(x) for x in row]], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def save(model: MixedModel, path: str, key: str = "") -> StoredModel:
    """Write the tables of a fit, then its manifest; an older model there is replaced."""
    spark, d = model.spark, model.design
    save_model_tables({"coef": model.coef, "ranef": model.ranef, "fit": model.fit}, path)
    spec = asdict(model.spec) | {"factors": {f: list(d.levels[f]) for f in model.spec.factors}}
    told = json.dumps({"spec": spec, "terms": d.terms, "levels": d.levels, "moments": d.moments, "dropped": d.dropped})
    spark.createDataFrame([(model.name, key, told)], "name string, key string, manifest string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return StoredModel(spark, path)


def load(spark: SparkSession, path: str) -> StoredModel:
    return StoredModel(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fitted(df: DataFrame, spec: ModelSpec, name: str, root: str | None = None) -> StoredModel:
    """The stored model of these rows and this specification; fitted and stored where there is none.

    ``root`` is the folder of the models: by default one beside the checkpoints, which all executors share."""
    spark = df.sparkSession
    root = root or f"{checkpoint_dir(spark).rstrip('/')}/models"
    key = model_key(df, spec)
    path = f"{root}/{name}-{key[:32]}"
    if exists(spark, path):
        model = load(spark, path)
        if model.key == key:
            return model
    return save(MixedModel(df, spec, name), path, key)
