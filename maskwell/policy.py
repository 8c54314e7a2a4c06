"""The policy: what is masked, from which score, and how dates, ages and postcodes are rewritten."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from . import vocab

# Default thresholds by category.
THRESHOLDS = {
    "NAME_PATIENT": 0.20, "NAME_PROVIDER": 0.20, "NAME_OTHER": 0.25, "ORG": 0.30, "GEO_STREET": 0.25, "GEO_CITY": 0.30, "GEO_ZIP": 0.30, "DATE": 0.25, "AGE": 0.40, "PHONE": 0.20, "FAX": 0.20, "EMAIL": 0.20, "SSN": 0.10,
    "MRN": 0.15, "HEALTH_PLAN_ID": 0.20, "ACCOUNT": 0.20, "LICENCE": 0.20, "VEHICLE": 0.20, "DEVICE": 0.25, "URL": 0.20, "IP": 0.20, "ID_GENERIC": 0.35, "PROFESSION": 0.45,
}
#: For a category that the policy doesn't name: it is masked.
DEFAULT_THRESHOLD = 0.30


@dataclass(frozen=True)
class Policy:
    date_mode: str = "interval_preserving"  # or safe_harbor, shifted
    retain_year: bool = False
    shift_window_days: int = 180
    interval_annotations: bool = True
    retain_under_90: bool = True
    over_89_placeholder: str = "[AGE_OVER_89]"
    zip_strategy: str = "truncate3"  # or remove
    restricted_zip3: tuple[str, ...] = vocab.RESTRICTED_ZIP3
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    retained: frozenset[str] = frozenset({"AGE"})
    structured_scale: float = 0.6
    selfcheck: bool = True
    on_leak: str = "block"  # or warn
    paranoid_threshold: float = 0.10
    review: bool = True
    review_low: float = 0.20
    review_high: float = 0.55
    vault_ttl_seconds: int = 3600
    vault_key_env: str = "MASKWELL_VAULT_KEY"
    eponyms: frozenset[str] = vocab.EPONYMS
    #: Ends a middle initial at a word boundary, so that "Elena Petrosyan" isn't cut to "Elena".
    bounded_initials: bool = False

    def threshold(self, category: str, structured: bool = False) -> float:
        return self.thresholds.get(category, DEFAULT_THRESHOLD) * (self.structured_scale if structured else 1.0)

    def masks(self, category: str) -> bool:
        return category not in self.retained


def load_policy(path: str | None = None, **changes) -> Policy:
    """A policy from a YAML or JSON file; defaults for what it lacks, unknown names are ignored."""
    policy = Policy()
    if path:
        try:
            with open(path, encoding="utf-8") as file:
                raw = file.read()
        except FileNotFoundError:
            return replace(policy, **changes)
        if path.endswith(".json"):
            tree = json.loads(raw)
        else:
            import yaml

            tree = yaml.safe_load(raw) or {}
        flat = dict(tree.get("policy", {}))
        section = lambda name: tree.get(name) or {}
        for name, at, key in (
            ("date_mode", "dates", "mode"), ("retain_year", "dates", "retain_year"), ("shift_window_days", "dates", "shift_window_days"), ("interval_annotations", "dates", "emit_interval_annotations"),
            ("retain_under_90", "ages", "retain_under_90"), ("over_89_placeholder", "ages", "over_89_placeholder"), ("zip_strategy", "geo", "zip_strategy"), ("restricted_zip3", "geo", "restricted_zip3"),
            ("structured_scale", "neural", "structured_segment_threshold_scale"), ("selfcheck", "selfcheck", "enabled"), ("on_leak", "selfcheck", "on_leak"), ("paranoid_threshold", "selfcheck", "paranoid_threshold"),
            ("review", "review_queue", "enabled"), ("review_low", "review_queue", "low"), ("review_high", "review_queue", "high"), ("vault_ttl_seconds", "vault", "ttl_seconds"), ("vault_key_env", "vault", "key_env"),
        ):
            if key in section(at):
                flat[name] = section(at)[key]
        named = {c: v for c, v in section("categories").items() if c in vocab.HIPAA}
        if named:
            flat["thresholds"] = {c: float(v.get("threshold", DEFAULT_THRESHOLD)) for c, v in named.items()}
            flat["retained"] = frozenset(c for c, v in named.items() if v.get("action", "mask") != "mask")
        known = {f.name for f in fields(Policy)}
        flat = {k: tuple(v) if k == "restricted_zip3" else frozenset(v) if k in ("retained", "eponyms") else v for k, v in flat.items() if k in known}
        policy = replace(policy, **flat)
    return replace(policy, **changes)
