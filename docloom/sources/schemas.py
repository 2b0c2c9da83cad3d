"""Document types from YAML files, and the small tables derived from them.

A new document type is a new file in the folder; no code changes.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
FOLDER = Path(__file__).resolve().parent.parent / "schemas"


@dataclass(frozen=True)
class Field:
    name: str
    section: str = "metadata"
    aliases: tuple[str, ...] = ()
    type: str = "string"
    required: bool = False
    strategies: tuple[str, ...] = ("key_value", "regex")
    patterns: tuple[str, ...] = ()
    min_value: float | None = None
    max_value: float | None = None
    weight: float = 1.0
    position: str | None = None
    markers: tuple[str, ...] = ()
    address_keywords: tuple[str, ...] = ()
    catalog: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    key: str
    name: str
    header_keywords: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    row_formula: str | None = None
    min_rows: int = 1


@dataclass(frozen=True)
class Rule:
    name: str
    rule_type: str
    expression: str
    severity: str = "error"
    message: str = ""


@dataclass(frozen=True)
class Schema:
    document_type: str
    title: str = ""
    title_keywords: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()
    table_indicators: tuple[str, ...] = ()
    min_score: float = 0.35
    sections: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    tables: tuple[Table, ...] = ()
    rules: tuple[Rule, ...] = ()
    marks: tuple[tuple[str, str, str], ...] = ()
    stop_keywords: tuple[str, ...] = ()
    auto_threshold: float = 0.88
    review_threshold: float = 0.70

    def fields_in(self, section: str) -> list[Field]:
        return [f for f in self.fields if f.section == section]


def _texts(value) -> tuple[str, ...]:
    return tuple(str(x) for x in value) if isinstance(value, list) else ()


def _columns(value) -> tuple[str, ...]:
    """Column keys from any of the four shapes: name to settings, name to aliases, settings, names."""
    if isinstance(value, dict):
        return tuple(value)
    return tuple(c["key"] if isinstance(c, dict) and "key" in c else c["name"] if isinstance(c, dict) else str(c) for c in value or [])


def parse_schema(data: dict) -> Schema:
    hints, catalogs = data.get("classification") or {}, data.get("entity_catalogs")
    catalogs = catalogs if isinstance(catalogs, dict) else {}
    fields = []
    for name, f in (data.get("fields") or {}).items():
        entries = _texts(catalogs.get(f.get("catalog_ref"))) or _texts(f.get("catalog_master"))
        fields.append(Field(
            name, f.get("section", "metadata"), _texts(f.get("aliases")), f.get("type", "string"), bool(f.get("required", False)),
            _texts(f["extraction_strategies"]) if "extraction_strategies" in f else Field.strategies, _texts(f.get("regex_patterns")),
            f.get("min_value"), f.get("max_value"), f.get("confidence_weight", 1.0), f.get("position"), _texts(f.get("tagline_markers")), _texts(f.get("address_keywords")), entries,
        ))
    tables = tuple(Table(k, t.get("name", k), _texts(t.get("header_keywords")), _columns(t.get("columns")), t.get("row_formula"), t.get("min_rows", 1)) for k, t in (data.get("tables") or {}).items())
    rules = tuple(Rule(r["name"], r.get("rule_type", "expression"), r.get("expression", ""), r.get("severity", "error"), r.get("message") or "") for r in data.get("validations") or [])
    marks = tuple((m["name"], m.get("mark_type", m["name"]), m.get("label", m["name"])) for m in (data.get("vision") or {}).get("marks") or [])
    return Schema(
        data["document_type"], data.get("title", data["document_type"]), _texts(hints.get("title_keywords")), _texts(hints.get("keywords")), _texts(hints.get("required_anchors")), _texts(hints.get("table_indicators")),
        hints.get("min_score_threshold", 0.35), _texts(data.get("sections")), tuple(fields), tables, rules, marks, _texts(data.get("stop_keywords")),
        data.get("auto_approve_threshold", 0.88), data.get("review_threshold", 0.70),
    )


def load_schema(path: str | Path) -> Schema | None:
    """One file; a broken one is logged and gives None."""
    try:
        return parse_schema(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except Exception as e:
        log.error("schema %s is passed over: %s", path, e)
        return None


@dataclass
class Registry:
    """All schemas by document type, in registered order, then other files of the folder by name."""

    schemas: dict[str, Schema] = field(default_factory=dict)
    #: Expressions made from the schemas, by name.
    built: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def shared(cls) -> Registry:
        """The package's own schemas, loaded once."""
        global _shared
        if _shared is None:
            _shared = cls.load()
        return _shared

    @classmethod
    def load(cls, folder: str | Path = FOLDER) -> Registry:
        folder, out = Path(folder), cls()
        listed = []
        if (index := folder / "registry.yaml").exists():
            listed = [folder / d["schema"] for d in (yaml.safe_load(index.read_text(encoding="utf-8")) or {}).get("document_types", {}).values()]
        for path in [*listed, *sorted(p for p in folder.glob("*.yaml") if p not in listed and p != index)]:
            if schema := load_schema(path):
                out.schemas.setdefault(schema.document_type, schema)
        return out

    def get(self, document_type: str) -> Schema | None:
        return self.schemas.get(document_type)

    @property
    def typed(self) -> list[Schema]:
        return [s for s in self.schemas.values() if s.document_type != "generic"]


_shared: Registry | None = None


def dimension(spark: SparkSession, registry: Registry, name: str) -> DataFrame:
    """A schema table as a DataFrame: schema, keyword, field, alias, pattern, catalog, table, rule or mark."""
    kinds = {
        "schema": "doc_type string, reg_ord int, title string, min_score double, auto_thr double, review_thr double", "keyword": "doc_type string, kind string, kw string, kw_ord int",
        "field": "doc_type string, field string, field_ord int, section string, type string, required boolean, min_value double, max_value double, weight double, position string",
        "alias": "doc_type string, field string, field_ord int, alias_ord int, alias string", "pattern": "doc_type string, field string, field_ord int, pat_ord int, pattern string", "catalog": "doc_type string, field string, entry_ord int, entry string",
        "table": "doc_type string, table_ord int, table string, columns array<string>", "rule": "doc_type string, rule_ord int, name string, rule_type string, expression string, severity string, message string", "mark": "doc_type string, name string, mark_type string, label string",
    }
    rows = []
    for k, s in enumerate(registry.schemas.values()):
        t, num = s.document_type, lambda x: None if x is None else float(x)
        if name == "schema":
            rows.append((t, k, s.title, float(s.min_score), float(s.auto_threshold), float(s.review_threshold)))
        elif name == "keyword":
            rows += [(t, kind, w, i) for kind, words in (("title", s.title_keywords), ("body", s.keywords), ("anchor", s.anchors), ("table", s.table_indicators)) for i, w in enumerate(words)]
        elif name == "field":
            rows += [(t, f.name, i, f.section, f.type, f.required, num(f.min_value), num(f.max_value), num(f.weight), f.position) for i, f in enumerate(s.fields)]
        elif name == "table":
            rows += [(t, i, x.name, list(x.columns)) for i, x in enumerate(s.tables)]
        elif name == "rule":
            rows += [(t, i, r.name, r.rule_type, r.expression, r.severity, r.message) for i, r in enumerate(s.rules)]
        elif name == "mark":
            rows += [(t, *m) for m in s.marks]
        elif name == "catalog":
            rows += [(t, f.name, j, e) for f in s.fields for j, e in enumerate(f.catalog)]
        else:
            rows += [(t, f.name, i, j, x) for i, f in enumerate(s.fields) for j, x in enumerate(f.aliases if name == "alias" else f.patterns)]
    return spark.createDataFrame(rows, kinds[name])
