"""Settings, from parameters or the environment; nothing in the library reads the environment by itself."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from .functions import lexicons as L


@dataclass(frozen=True)
class Config:
    alert_at: float = L.ALERT_AT
    publish_at: float = L.PUBLISH_AT
    index_at: float = L.INDEX_AT
    hot_hours: float = 24
    history_hours: float = 48
    base_url: str = "https://example.com"

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ, prefix: str = "TRENDS_") -> Config:
        own = {f.name: type(f.default)(env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env}
        return cls(**own)
