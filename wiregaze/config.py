"""Settings, layered: defaults, then a JSON file, then environment, then explicit overrides."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

ENV_PREFIX = "WIREGAZE_"


@dataclass(frozen=True)
class Config:
    interface: str = "any"
    packet_buffer: int = 5000
    queue_size: int = 100_000
    zscore_window: int = 30
    zscore_threshold: float = 3.0
    ddos_min_pps: int = 500
    ddos_consecutive_intervals: int = 3
    knn_k: int = 3
    kmeans_k: int = 3
    kmeans_alpha: float = 0.05
    payload_confidence: float = 0.80
    alert_dedup_seconds: float = 5.0
    source_attribution_min_share: float = 0.50
    block_enabled: bool = False
    block_whitelist: tuple[str, ...] = ("127.0.0.1", "0.0.0.0")
    block_on: tuple[str, ...] = ("payload", "blacklist", "ddos", "scan")
    payload_excerpt_bytes: int = 64
    privacy_mode: bool = True
    anonymise_ips: bool = False
    udp_host: str = "127.0.0.1"
    udp_port: int = 9999
    http_port: int = 8080
    blacklist_file: str | None = None
    bloom_size: int = 1000
    bloom_hashes: int = 3
    pcap_file: str | None = None
    pcap_snaplen: int = 96
    brain_file: str = "data/brain.json"
    log_file: str = "alerts.csv"

    @classmethod
    def load(cls, path: str | None = None, environ: Mapping[str, str] | None = None, **overrides: Any) -> Config:
        known = {f.name: f.default for f in dataclasses.fields(cls)}
        values: dict[str, Any] = {}
        if path and Path(path).exists():
            values |= json.loads(Path(path).read_text())
        env = os.environ if environ is None else environ
        values |= {k[len(ENV_PREFIX) :].lower(): v for k, v in env.items() if k.startswith(ENV_PREFIX)}
        values |= {k: v for k, v in overrides.items() if v is not None}
        good = {}
        for k, v in values.items():
            if k in known:
                try:
                    good[k] = coerce(v, known[k])
                except (TypeError, ValueError):
                    continue  # a bad value leaves the layer below in force
        return cls(**good)


def coerce(value: Any, like: Any) -> Any:
    """A string in the type of the default ``like``; other values are converted where the type differs."""
    if isinstance(like, bool):
        if isinstance(value, str):
            return value.strip().lower() in ("1", "true", "yes", "on")
        return bool(value)
    if isinstance(like, tuple):
        parts = value.split(",") if isinstance(value, str) else value
        return tuple(str(p).strip() for p in parts if str(p).strip())
    if isinstance(like, int):
        return int(value)
    if isinstance(like, float):
        return float(value)
    return None if value is None else str(value)
