"""Settings of the export and enforcement paths, validated once; nothing here touches data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    endpoint: str = ""
    api_key: str = ""
    service_name: str = "agent"
    redact: bool = True
    insecure: bool = False
    ca_file: str | None = None
    gate_timeout_s: float = 120.0
    decide_timeout_s: float = 3.0
    enabled: bool = True

    def __post_init__(self):
        if bool(self.endpoint.strip()) != bool(self.api_key.strip()):
            raise ValueError("endpoint and key belong together; with one of them missing nothing would be sent")
        if self.gate_timeout_s <= 0 or self.decide_timeout_s <= 0:
            raise ValueError("timeouts are positive")

    @property
    def enforcing(self) -> bool:
        """Enforcement needs both an endpoint and a key; else everything is only observed."""
        return self.enabled and bool(self.endpoint.strip() and self.api_key.strip())

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "TRACEWRIGHT_") -> Settings:
        """Settings from environment-like pairs, blanks trimmed; unknown names are left alone."""
        get = lambda name: env.get(prefix + name, "").strip()
        return cls(endpoint=get("ENDPOINT"), api_key=get("API_KEY"), redact=get("REDACT").lower() not in ("0", "false", "no"), insecure=get("INSECURE").lower() in ("1", "true", "yes"), ca_file=get("CA_FILE") or None, gate_timeout_s=float(get("GATE_TIMEOUT") or 120))
