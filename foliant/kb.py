"""The knowledge base and the filing profiles: plan-time constants, read from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

DATA = Path(__file__).parent / "data"
ILLEGAL = '<>:"/\\|?*'


@dataclass(frozen=True)
class KnowledgeBase:
    data: dict

    @staticmethod
    def load(path: str | None = None) -> "KnowledgeBase":
        data = json.loads(Path(path or DATA / "knowledge_base.json").read_text())
        if not data.get("documents"):
            raise ValueError("the knowledge base has no documents")
        if "scoring" not in data:
            raise ValueError("the knowledge base has no scoring section")
        return KnowledgeBase(data)

    @cached_property
    def types(self) -> list[dict]:
        out = []
        for k, d in enumerate(self.data["documents"]):
            out.append({"id": d["id"], "ord": k, "abbrev": d.get("abbrev") or d["id"].upper().replace(" ", ""), "name": d.get("name", d["id"]), "category": d.get("category"), "advice_record": bool(d.get("advice_record_role")), "client_specific": d.get("client_specific", True) is not False, "requires_date": bool(d.get("requires_date")), "hints": d.get("classifier_hints", {})})
        return out

    def ids(self, key: str) -> list[str]:
        """Type ids for which a property holds."""
        return [t["id"] for t in self.types if t[key]]

    @property
    def weights(self) -> dict:
        return self.data["scoring"]["weights"]

    @property
    def head_chars(self) -> int:
        return self.data["scoring"].get("title_position", {}).get("head_chars", 300)

    @property
    def short_max(self) -> int:
        return self.data["scoring"].get("short_pattern_rule", {}).get("max_length", 4)

    @property
    def ascii_edges(self) -> bool:
        """Whether a short phrase ends at any character that is no ASCII letter, digit or underscore; else at one that is none of any script."""
        return self.data["scoring"].get("short_pattern_rule", {}).get("edges") == "ascii"

    @property
    def threshold(self) -> float:
        return self.data["scoring"]["confidence"]["threshold"]

    @property
    def floor(self) -> float:
        return self.data["scoring"]["confidence"]["evidence_floor"]

    @property
    def subjects(self) -> list[dict]:
        return self.data.get("advice_subjects", {}).get("subjects", [])

    @property
    def risk_categories(self) -> list[str]:
        return sorted(self.data.get("risk_categories", {}).get("values", []), key=len, reverse=True)

    @cached_property
    def rules(self) -> dict[str, dict]:
        return {r["id"]: {"severity": "medium", "class": "placement", "trigger": "", "why": "", **r} for r in self.data["edge_case_flags"]["rules"]}

    def rule(self, rule_id: str) -> dict:
        if rule_id not in self.rules:
            raise KeyError(f"no flag rule {rule_id!r} in the knowledge base")
        return self.rules[rule_id]

    @property
    def attachment(self) -> dict:
        return self.data.get("filing_model", {}).get("attachment_rules", {})

    @property
    def max_gap_days(self) -> int:
        return int(self.attachment.get("max_gap_days", 730))

    def direction(self, category: str | None) -> str:
        return self.attachment.get("by_category", {}).get(category or "", {}).get("direction", "backward")

    @property
    def matching(self) -> dict:
        return {"match": 0.80, "ambiguous_margin": 0.12, "propose_new_below": 0.55, **self.data.get("client_matching", {}).get("thresholds", {})}

    @property
    def era_boundary(self) -> str | None:
        return self.data.get("reform_watch", {}).get("dbfo_tranche_1", {}).get("consent_regime_commencement")

    def with_threshold(self, threshold: float) -> "KnowledgeBase":
        data = json.loads(json.dumps(self.data))
        data["scoring"]["confidence"]["threshold"] = threshold
        return KnowledgeBase(data)


@dataclass(frozen=True)
class Profile:
    data: dict

    @staticmethod
    def available() -> list[str]:
        return sorted(p.stem for p in (DATA / "profiles").glob("*.json"))

    @staticmethod
    def load(name: str = "nested") -> "Profile":
        path = Path(name) if name.endswith(".json") else DATA / "profiles" / f"{name}.json"
        if not path.exists():
            raise ValueError(f"no profile {name!r}; available: {', '.join(Profile.available())}")
        return Profile(json.loads(path.read_text()))

    @property
    def illegal(self) -> str:
        """Characters that no folder's or file's name may have."""
        return self.illegal_chars + self.extra_illegal_chars

    def __getattr__(self, key: str):
        defaults = {"charset": "unicode", "max_path_chars": 260, "max_name_chars": 120, "illegal_chars": ILLEGAL, "extra_illegal_chars": "", "type_labels": {}, "categories": {}, "description": ""}
        data = object.__getattribute__(self, "data")
        if key in data:
            return data[key]
        if key in defaults:
            return defaults[key]
        raise AttributeError(key)
