"""Immutable generations of a table with a manifest: shadow build, check, switch, backup, restore."""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Generations under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    @property
    def manifest(self) -> dict:
        try:
            with open(f"{self.root}/manifest.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"current": None, "generations": []}

    def _switch(self, m: dict) -> None:
        tmp = f"{self.root}/manifest.json.tmp"
        with open(tmp, "w") as f:
            json.dump(m, f, indent=1)
        os.replace(tmp, f"{self.root}/manifest.json")

    def publish(self, df: DataFrame, fingerprint: dict | None = None, expected: int | None = None, max_failed: float = 0.02, now: float | None = None) -> int:
        """Writes the next generation and switches to it if enough rows came through."""
        m = self.manifest
        n = max([g["n"] for g in m["generations"]], default=0) + 1
        path = f"{self.root}/gen-{n:06d}"
        df.write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path).count()
        if expected and (expected - rows) / expected > max_failed:
            raise RuntimeError(f"generation {n} has {rows} of {expected} rows; the current one stays")
        key = hashlib.sha256(json.dumps(fingerprint or {}, sort_keys=True).encode()).hexdigest()
        m["generations"].append({"n": n, "rows": rows, "fingerprint": key, "at": time.time() if now is None else now})
        m["current"] = n
        self._switch(m)
        return n

    def read(self, n: int | None = None) -> DataFrame:
        n = n or self.manifest["current"]
        if n is None:
            raise FileNotFoundError(f"{self.root} has no generation")
        return self.spark.read.parquet(f"{self.root}/gen-{n:06d}")

    def restore(self, n: int) -> None:
        m = self.manifest
        if n not in [g["n"] for g in m["generations"]]:
            raise KeyError(n)
        self._switch(m | {"current": n})

    def list(self) -> list[dict]:
        return sorted(self.manifest["generations"], key=lambda g: -g["n"])

    def changed(self, fingerprint: dict) -> bool:
        """Whether the provider's settings differ from those of the current generation."""
        m = self.manifest
        key = hashlib.sha256(json.dumps(fingerprint, sort_keys=True).encode()).hexdigest()
        return next((g["fingerprint"] for g in m["generations"] if g["n"] == m["current"]), None) != key
