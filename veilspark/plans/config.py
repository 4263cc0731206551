"""Processing configuration: validated on the driver before a plan exists."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from veilspark.functions.tables import ENTITY_TYPES, LANGUAGES, STRATEGIES


@dataclass(frozen=True)
class Config:
    language: str = "auto"
    risk_level: str = "strict"
    strategy: str = "mask"
    privacy_strength: int = 2
    enabled_entity_types: tuple[str, ...] = ENTITY_TYPES
    preserve_terms: tuple[str, ...] = ()
    custom_rules: tuple[dict, ...] = ()
    policies: dict[str, str] = field(default_factory=dict)
    instruction: str = ""
    seed: int = 0

    def __post_init__(self):
        if self.language not in LANGUAGES or self.strategy not in STRATEGIES or self.risk_level not in ("standard", "strict"):
            raise ValueError("unknown language, strategy or risk level")
        if not 1 <= self.privacy_strength <= 3:
            raise ValueError("privacy_strength must be 1 to 3")
        if bad := set(self.enabled_entity_types) - set(ENTITY_TYPES):
            raise ValueError(f"unknown entity types {sorted(bad)}")

    def overlay(self, explicit: dict) -> Config:
        """This configuration with the fields that a request sent."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in explicit.items() if k in known and v is not None})

    def instructed(self, plan: dict) -> Config:
        """With an instruction's plan: types replace, terms append, strategy and strength override."""
        forced = tuple({"id": f"instruction_{i}", "name": "instruction", "kind": "keyword", "pattern": t, "entity_type": "CUSTOM"} for i, t in enumerate(plan.get("force_terms") or ()))
        return replace(
            self,
            enabled_entity_types=tuple(plan.get("enabled_entity_types") or self.enabled_entity_types),
            preserve_terms=(*self.preserve_terms, *(plan.get("preserve_terms") or ())),
            custom_rules=(*self.custom_rules, *forced),
            strategy=plan.get("strategy") or self.strategy,
            privacy_strength=plan.get("privacy_strength") or self.privacy_strength,
        )
