"""All registered queries: name -> (spark_fn(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["tickets_q", "prices_q", "text_q", "vectors_q", "io_q", "models_q"]


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        try:
            mod = importlib.import_module(f"tidemark.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name == f"tidemark.plans.{m}":
                continue
            raise
        for name, v in mod.Q.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = v
    return out
