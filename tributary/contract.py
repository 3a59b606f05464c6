"""The declared target contract: which fields a canonical record has.

A contract is configuration (tens of fields), so it lives on the driver and
reaches the executors as literals inside expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field as dc_field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIELD_TYPES = ("string", "email", "phone", "date", "enum", "decimal")


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    sensitive: bool = False
    identity: bool = False
    pattern: str | None = None
    references: str | None = None
    min: float | None = None
    max: float | None = None
    description: str = ""
    values: dict[str, list[str]] = dc_field(default_factory=dict)

    @property
    def anchored_pattern(self) -> str | None:
        """The pattern matched from the start of the value, as declared."""
        if self.pattern is None:
            return None
        return self.pattern if self.pattern.startswith("^") else "^(?:" + self.pattern + ")"

    def vocabulary(self) -> dict[str, str]:
        """lower-cased word -> canonical value; the first declaration wins."""
        words: dict[str, str] = {}
        for canonical, synonyms in self.values.items():
            for word in (canonical, *synonyms):
                words.setdefault(word.strip().lower(), canonical)
        return words


@dataclass(frozen=True)
class Contract:
    entity: str
    fields: tuple[Field, ...]

    @classmethod
    def from_dict(cls, doc: dict[str, Any]) -> "Contract":
        if not doc or "entity" not in doc or "fields" not in doc:
            raise ValueError("a contract needs 'entity' and 'fields'")
        fields = []
        for name, props in doc["fields"].items():
            known = {k: v for k, v in (props or {}).items() if k in Field.__dataclass_fields__ and v is not None}
            fld = Field(name=name, **known)
            if fld.type not in FIELD_TYPES:
                raise ValueError(f"field {name}: unknown type {fld.type}")
            fields.append(fld)
        return cls(doc["entity"], tuple(fields))

    @classmethod
    def load(cls, path: str | Path) -> "Contract":
        """Read a contract from a YAML or JSON file."""
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            return cls.from_dict(json.loads(text))
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("YAML contracts need PyYAML; use a JSON contract instead") from exc
        return cls.from_dict(yaml.safe_load(text))

    def __getitem__(self, name: str) -> Field:
        for fld in self.fields:
            if fld.name == name:
                return fld
        raise KeyError(name)

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def of_type(self, *types: str) -> list[Field]:
        return [f for f in self.fields if f.type in types]

    @property
    def identity(self) -> list[Field]:
        return [f for f in self.fields if f.identity]

    @property
    def required(self) -> list[Field]:
        return [f for f in self.fields if f.required]

    @property
    def sensitive(self) -> list[Field]:
        return [f for f in self.fields if f.sensitive]

    def as_frame(self, spark: SparkSession) -> DataFrame:
        """The contract as a table, one row per field."""
        schema = (
            "field string, ordinal int, type string, required boolean, sensitive boolean, "
            "identity boolean, pattern string, references string, min double, max double, "
            "values map<string,array<string>>"
        )
        rows = [
            (f.name, i, f.type, f.required, f.sensitive, f.identity, f.pattern, f.references,
             None if f.min is None else float(f.min), None if f.max is None else float(f.max),
             {k: list(v) for k, v in f.values.items()})
            for i, f in enumerate(self.fields)
        ]
        return spark.createDataFrame(rows, schema)

    def literal_map(self, pairs: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def employee_contract(id_pattern: str = r"^E\d{4}$",
                      departments: dict[str, list[str]] | None = None) -> Contract:
    """The shipped employee contract; the id pattern and departments may differ per client."""
    # Field flags, canonical enum values and their synonyms.
    return Contract.from_dict({
        "entity": "employee",
        "fields": {
            "employee_id": {"type": "string", "required": True, "identity": True, "pattern": id_pattern},
            "first_name": {"type": "string", "required": True},
            "last_name": {"type": "string", "required": True},
            "email": {"type": "email", "required": True, "identity": True},
            "phone": {"type": "phone"},
            "date_of_birth": {"type": "date", "sensitive": True},
            "hire_date": {"type": "date", "required": True},
            "department": {"type": "enum", "required": True, "values": departments or {
                "Engineering": ["eng", "engg", "tech", "software", "development"],
                "HR": ["human resources", "people ops", "people operations", "personnel"],
                "Finance": ["fin", "accounts", "accounting", "treasury"],
                "Sales": ["sales & marketing", "sales", "business development", "marketing"],
                "Operations": ["ops", "logistics", "supply chain"],
            }},
            "job_title": {"type": "string"},
            "manager_id": {"type": "string", "references": "employee_id", "pattern": id_pattern},
            "employment_status": {"type": "enum", "required": True, "values": {
                "Active": ["active", "act", "current", "employed"],
                "Terminated": ["terminated", "resigned", "exited", "left", "inactive"],
                "On Leave": ["on leave", "leave", "sabbatical"],
            }},
            "salary": {"type": "decimal", "sensitive": True, "min": 0},
        },
    })
