"""Typed decisions (R5): what a fitted layer decided, as rows (layer, column, decision, number, detail).

``expand`` reads them off the layer's fitted parameters, so the log can't differ from what was applied; the text of a log
line is printed from its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass


@dataclass(frozen=True)
class Decision:
    layer: str
    column: str | None
    decision: str
    number: float | None = None
    detail: str | None = None

    def text(self) -> str:
        parts = [self.decision.replace("_", " ")]
        if self.column is not None:
            parts.append(f"[{self.column}]")
        if self.number is not None:
            parts.append(f"= {self.number:g}")
        if self.detail:
            parts.append(f"({self.detail})")
        return " ".join(parts)


def _fill(layer: str, d: dict) -> Decision:
    v = d.get("value")
    number = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    return Decision(layer, d["column"], f"fill_by_{d['strategy']}", number, None if number is not None or v is None else str(v))


def _names(p: dict) -> Iterator[Decision]:
    for old, new in p["renamed"].items():
        yield Decision("schema", new, "renamed", detail=old)


def _schema(p: dict) -> Iterator[Decision]:
    for c in p["type_conversions"]:
        yield Decision("schema", c["column"], f"read_as_{c['target_type']}")
    for c, how in p["conversions"].items():
        if how["to"] == "id":
            yield Decision("schema", c, "kept_as_id")


def _semantic(p: dict) -> Iterator[Decision]:
    for c in p["dates"]:
        yield Decision("semantic", c if isinstance(c, str) else str(c), "zone_dropped")
    for c in p["missing_tokens"]:
        yield Decision("semantic", c, "tokens_to_missing")
    for c, to in p["canonical_mappings"].items():
        yield Decision("semantic", c, "categorical_standardized", detail=to)


def _missing(layer: str):
    def rows(p: dict) -> Iterator[Decision]:
        for d in p["dropped_columns"]:
            yield Decision(layer, d["column"], "sparse_dropped", d["missing_ratio"])
        for d in p["imputations"]:
            yield _fill(layer, d)
        for c in p["indicator_columns"]:
            yield Decision(layer, c, "indicator_added")
    return rows


def _bounds(layer: str):
    def rows(p: dict) -> Iterator[Decision]:
        for a in p["actions"]:
            yield Decision(layer, a["column"], "bounded", a.get("outside"), f"{a['lower']} .. {a['upper']}")
            if a.get("flag_column"):
                yield Decision(layer, a["flag_column"], "flag_added")
    return rows


def _consistency(p: dict) -> Iterator[Decision]:
    if p["duplicates_removed"]:
        yield Decision("consistency", None, "copies_removed", p["duplicates_removed"])
    for c in p["constant_columns_dropped"]:
        yield Decision("consistency", c, "constant_dropped")
    for a in p["numeric_adjustments"]:
        yield Decision("consistency", a.get("column"), str(a.get("rule", "adjusted")), a.get("rows"))
    for a in p["date_corrections"]:
        yield Decision("consistency", a["end"], "moved_to_start", a["rows"], a["start"])


def _features(p: dict) -> Iterator[Decision]:
    for key, what in (("datetime", "date_parts_added"), ("skewed_numeric", "log1p_added"), ("text_features", "text_features_added")):
        for c in p[key]:
            yield Decision("features", c, what)
    for e in p["categorical_encoded"]:
        onehot = e["method"] == "onehot"
        yield Decision("features", e["column"], "one_hot_encoded" if onehot else "label_encoded", len(e["categories"]) if onehot else e["cardinality"])


def _scaled(p: dict) -> Iterator[Decision]:
    for c, (lo, hi) in p["columns"].items():
        yield Decision("auto_clean", c, "scaled_to_unit_range", None, f"{lo} .. {hi}")


def _steps(p: dict) -> Iterator[Decision]:
    for a in p["actions"]:
        v = a.get("value")
        number = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        yield Decision("manual", a["column"], "_".join(x for x in (a["action"], a.get("method")) if x), number)


_OF_LAYER = {
    "names": _names, "schema": _schema, "semantic": _semantic, "missing": _missing("missing"), "outliers": _bounds("outliers"),
    "consistency": _consistency, "features": _features, "residual": _missing("residual_fill"), "basic_impute": _missing("auto_clean"),
    "clip_all": _bounds("auto_clean"), "normalize_all": _scaled, "steps": _steps,
}


def expand(layer: str, params: dict) -> list[Decision]:
    return list(_OF_LAYER[layer](params)) if layer in _OF_LAYER else []


def as_row(d: Decision) -> tuple:
    return tuple(float(v) if k == 3 and v is not None else v for k, v in enumerate(astuple(d)))
