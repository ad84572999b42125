"""Fitted recipe: the frozen parameters of a run, its audit log, and replay.

A recipe is an ordered list of ``(layer, params)`` with plain JSON values
(fill literals, fences, categories, rename map).  ``apply`` replays it on any
DataFrame with the same input columns as a lazy projection (plus the one
deduplication shuffle and the factorize dictionary joins).  Factorize
dictionaries are DataFrames; ``save`` writes them next to the JSON.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from scour.operators import consistency, features, isolation, missing, neighbours, outliers, schema, semantic, steps
from scour.plans import decisions


def _default(o):
    if hasattr(o, "isoformat"):
        return o.isoformat()
    raise TypeError(type(o))


@dataclass
class Recipe:
    layers: list = field(default_factory=list)  # [(name, params)]
    roles: dict = field(default_factory=dict)
    log: list = field(default_factory=list)  # [(layer, column, decision, number, detail)]
    stats: dict = field(default_factory=dict)
    dictionaries: dict = field(default_factory=dict)  # column -> (DataFrame, size)

    def add(self, name: str, params: dict) -> None:
        """Keep a layer's fitted parameters and log the decisions in them."""
        self.layers.append((name, params))
        self.log += [decisions.as_row(d) for d in decisions.expand(name, params)]

    def decide(self, layer: str, decision: str, number: float | None = None, *, column: str | None = None, detail: str | None = None) -> None:
        """Log a decision that isn't a layer's parameter."""
        self.log.append(decisions.as_row(decisions.Decision(layer, column, decision, number, detail)))

    def params(self, name: str):
        for n, p in self.layers:
            if n == name:
                return p
        return None

    # ------------------------------------------------------------------ replay
    def apply(self, df: DataFrame, *, streaming_dedup: bool = True) -> DataFrame:
        """Replay every fitted layer on ``df``.

        On a streaming frame, deduplication keeps a digest of every distinct row as state;
        ``streaming_dedup=False`` leaves it out.
        """
        for name, p in self.layers:
            if name == "names":
                df = schema.apply_names(df, p["renamed"])
            elif name == "schema":
                df = schema.apply_schema(df, p)
            elif name == "semantic":
                df = semantic.apply_semantic(df, p)
            elif name == "missing":
                df = missing.apply_missing(df, p)
            elif name == "outliers":
                df = outliers.apply_outliers(df, p)
            elif name == "consistency":
                if df.isStreaming:
                    if streaming_dedup and p.get("dedup", True):
                        df = consistency.drop_repeated_rows(df)
                    df = consistency.apply_consistency(df, dict(p, dedup=False))
                else:
                    df = consistency.apply_consistency(df, p)
            elif name == "features":
                df = features.apply_features(df, p, dict(self.dictionaries))
            elif name == "residual":
                df = missing.apply_missing(df, p, indicators=False)
            elif name == "bools":
                df = features.bools_to_int(df)
            elif name == "basic_impute":
                df = missing.apply_missing(df, p, indicators=False)
            elif name == "clip_all":
                df = outliers.apply_outliers(df, p, flags=False)
            elif name == "normalize_all":
                df = _apply_minmax(df, p)
            elif name == "steps":
                df = _replay_steps(df, p, self.dictionaries)
            else:
                raise ValueError(f"unknown layer {name}")
        return df

    # --------------------------------------------------------------- audit log
    def log_df(self, spark: SparkSession) -> DataFrame:
        """(seq, layer, column, decision, number, detail, message) in the order of the run; the message is printed
        from the other columns."""
        rows = [(i + 1, *d, decisions.Decision(*d).text()) for i, d in enumerate(self.log)]
        return spark.createDataFrame(rows, "seq int, layer string, column string, decision string, number double, detail string, message string")

    def actions(self) -> dict:
        return {n: p for n, p in self.layers}

    # ------------------------------------------------------------------- JSON
    def to_json(self) -> str:
        return json.dumps({"layers": self.layers, "roles": self.roles, "log": self.log, "stats": self.stats,
                           "dictionaries": sorted(self.dictionaries)}, default=_default)

    def save(self, path: str) -> None:
        """Write ``recipe.json`` and one parquet folder per factorize dictionary under ``path``
        (any Hadoop-compatible path; the JSON is written through Spark too)."""
        spark = None
        for i, col in enumerate(sorted(self.dictionaries)):
            d = self.dictionaries[col][0]
            spark = d.sparkSession
            d.write.mode("overwrite").parquet(os.path.join(path, "dictionaries", str(i)))
        if spark is None:
            spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.to_json(),)], "recipe string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "recipe"))

    @staticmethod
    def from_json(text: str, spark: SparkSession | None = None, path: str | None = None) -> "Recipe":
        d = json.loads(text)
        r = Recipe([tuple(x) for x in d["layers"]], d.get("roles", {}), [tuple(x) for x in d.get("log", [])],
                   d.get("stats", {}))
        if path is not None and spark is not None:
            for i, col in enumerate(d.get("dictionaries", [])):
                t = spark.read.parquet(os.path.join(path, "dictionaries", str(i)))
                r.dictionaries[col] = (t, t.count())
        return r

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Recipe":
        text = spark.read.text(os.path.join(path, "recipe")).collect()[0][0]
        return Recipe.from_json(text, spark, path)


def _apply_minmax(df: DataFrame, p: dict) -> DataFrame:
    from pyspark.sql import functions as F

    from scour.functions import types as KT
    from scour.functions.exprs import nan_to_null, qcol
    sc = {c: v for c, v in p["columns"].items()}
    out = []
    for c in df.columns:
        if c in sc:
            lo, hi = sc[c]
            v = nan_to_null(qcol(c), KT.dtype_of(df, c)).cast("double")
            out.append(((v - F.lit(lo)) / F.lit(hi - lo)).alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def _replay_steps(df: DataFrame, p: dict, dictionaries: dict | None = None) -> DataFrame:
    """Replay manual steps with their fitted values and dictionaries (no refit)."""
    from pyspark.sql import functions as F

    from scour.functions import types as KT
    from scour.functions.exprs import nan_to_null, put, qcol
    for a in p["actions"]:
        col = a["column"]
        if col not in df.columns:
            continue
        act, m = a["action"], a.get("method")
        if act == "drop":
            df = df.drop(col)
        elif act == "impute" and m == "knn":
            donors = (dictionaries or {}).get(f"step:{col}")
            if donors is None:
                raise ValueError(f"the rows that fill {col!r} are not part of this recipe")
            df = neighbours.knn_impute(df, a["columns"], [col], k=a["k"], donors=donors[0])
        elif act == "impute":
            if a.get("value") is not None:
                df = missing.impute(df, col, "custom", a["value"])
        elif act == "scale" and m == "none":
            continue
        elif act == "scale":
            v = nan_to_null(qcol(col), KT.dtype_of(df, col)).cast("double")
            if m == "standard":
                e = (v - F.lit(a["mean"] or 0.0)) / F.lit(a["scale"])
            elif m == "minmax":
                e = (v - F.lit(a["min"] or 0.0)) / F.lit(a["range"])
            else:
                e = (v - F.lit(a["center"] or 0.0)) / F.lit(a["scale"])
            df = df.select(*[e.alias(c) if c == col else qcol(c) for c in df.columns])
        elif act == "outliers":
            df = isolation.apply_isolation(df, a["forest"], a["threshold"], f"{col}_")
        elif act == "encode" and m == "onehot":
            vals = [n[len(col) + 1:] for n in a["new_columns"]]
            df = df.select(*put([c for c in df.columns if c != col], features.one_hot_exprs(col, vals)))
        elif act == "encode" and m == "label":
            df = features.label_encode(df, col, (dictionaries or {}).get(f"step:{col}"))
    return df


__all__ = ["Recipe", "steps"]
