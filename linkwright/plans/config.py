"""Job configuration: YAML to dataclasses, with defaults, derived field lists and validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from linkwright.functions.fuzzy import SCORERS
from linkwright.operators.scoring import MatchField

METHODS = ("exact", "fuzzy", "embedding", "numeric", "bm25", "synonym")
SAFE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")
FORMATS = {"csv": "csv", "tsv": "csv", "parquet": "parquet", "jsonl": "jsonl", "ndjson": "jsonl"}


class ConfigError(ValueError):
    pass


@dataclass
class Dataset:
    path: str
    id_field: str
    common_id_field: str | None = None
    format: str | None = None
    encoding: str = "utf-8"

    @property
    def kind(self) -> str | None:
        return self.format or FORMATS.get(self.path.rsplit(".", 1)[-1].lower())

    @property
    def delimiter(self) -> str:
        return "\t" if self.path.lower().endswith(".tsv") else ","


@dataclass
class Config:
    name: str
    a: Dataset
    b: Dataset
    fields: list[MatchField]
    auto: float
    floor: float
    min_gap: float = 0.0
    top_n: int = 5
    ann_candidates: int = 50
    bm25_candidates: int = 10
    blocking: list[tuple[str, str]] = field(default_factory=list)  # (a field, b field)
    prefilter: list[tuple[str, str]] = field(default_factory=list)
    bm25_fields: list[tuple[str, str]] = field(default_factory=list)
    synonym_fields: list[tuple[str, str, int]] = field(default_factory=list)  # with the least length
    dictionary: str | None = None
    candidates: str = "generators"  # or "blocked": every blocked pair is scored
    output_mapping: dict[str, str] = field(default_factory=dict)
    crossmap_path: str | None = None
    crossmap_a: str = "a_id"
    crossmap_b: str = "b_id"
    exclusions_path: str | None = None
    exclusions_a: str = "a_id"
    exclusions_b: str = "b_id"
    output: dict[str, Any] = field(default_factory=dict)
    scoring_log: bool = False
    cleanup_match_log: bool = False
    encoder: dict[str, Any] = field(default_factory=dict)
    encoder_timeout: float = 60.0
    limit: int | None = None
    hooks: str | None = None

    def required(self, side: str) -> list[str]:
        """The fields of a side that the job reads, sorted."""
        at = 0 if side == "a" else 1
        own = self.a if side == "a" else self.b
        names = {own.id_field, *( [own.common_id_field] if own.common_id_field else [])}
        names |= {getattr(f, f"field_{side}") for f in self.fields if f.method != "bm25"}
        for pairs in (self.blocking, self.prefilter, self.bm25_fields, self.synonym_fields):
            names |= {p[at] for p in pairs}
        if side == "a":
            names |= set(self.output_mapping)
        return sorted(n for n in names if n)


def _get(d: Any, path: str, default: Any = None) -> Any:
    for key in path.split("."):
        if not isinstance(d, dict) or d.get(key) is None:
            return default
        d = d[key]
    return d


def _pairs(items: Any) -> list[tuple[str, str]]:
    return [(p.get("field_a", ""), p.get("field_b", "")) for p in items or []]


def parse(text: str) -> Config:
    """A configuration from YAML, validated."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError("a configuration is a mapping")
    return from_dict(raw)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def from_dict(raw: dict) -> Config:
    data = {s: _get(raw, f"datasets.{s}", {}) for s in ("a", "b")}
    fields, inline = [], []
    for f in raw.get("match_fields") or []:
        fields.append(MatchField(f.get("method", ""), float(f.get("weight", 0.0)), f.get("field_a") or "", f.get("field_b") or "", f.get("scorer") or "wratio"))
        inline += _pairs(f.get("fields")) if f.get("method") == "bm25" else []
    blocking, prefilter = raw.get("blocking") or {}, raw.get("exact_prefilter") or {}
    block = _pairs(blocking.get("fields")) or ([(blocking["field_a"], blocking.get("field_b", ""))] if blocking.get("field_a") else [])
    bm25 = inline or _pairs(raw.get("bm25_fields"))
    if not bm25 and any(f.method == "bm25" for f in fields):  # by default the texts that are compared anyway
        bm25 = [(f.field_a, f.field_b) for f in fields if f.method in ("fuzzy", "embedding")]
    synonyms = [(p.get("field_a", ""), p.get("field_b", ""), int(_get((p.get("generators") or [{}])[0], "min_length", 3))) for p in raw.get("synonym_fields") or []]
    synonyms = synonyms or [(f.field_a, f.field_b, 3) for f in fields if f.method == "synonym"]
    c = Config(
        name=_get(raw, "job.name", ""),
        **{s: Dataset(d.get("path") or "", d.get("id_field") or "", d.get("common_id_field"), d.get("format"), d.get("encoding") or "utf-8") for s, d in data.items()},
        fields=fields,
        auto=float(_get(raw, "thresholds.auto_match", 0.85)),
        floor=float(_get(raw, "thresholds.review_floor", 0.6)),
        min_gap=float(_get(raw, "thresholds.min_score_gap", 0.0)),
        top_n=int(raw.get("top_n", 5)),
        ann_candidates=int(raw.get("ann_candidates", 50)),
        bm25_candidates=int(raw.get("bm25_candidates", 10)),
        blocking=block if blocking.get("enabled", bool(block)) else [],
        prefilter=_pairs(prefilter.get("fields")) if prefilter.get("enabled", bool(prefilter)) else [],
        bm25_fields=bm25,
        synonym_fields=synonyms,
        dictionary=_get(raw, "synonym_dictionary.path"),
        candidates=raw.get("candidates", "generators"),
        output_mapping={m.get("from", ""): m.get("to", "") for m in raw.get("output_mapping") or []},
        crossmap_path=_get(raw, "cross_map.path"),
        crossmap_a=_get(raw, "cross_map.a_id_field", "a_id"),
        crossmap_b=_get(raw, "cross_map.b_id_field", "b_id"),
        exclusions_path=_get(raw, "exclusions.path"),
        exclusions_a=_get(raw, "exclusions.a_id_field", ""),
        exclusions_b=_get(raw, "exclusions.b_id_field", ""),
        output=raw.get("output") or {},
        scoring_log=bool(_get(raw, "scoring_log.enabled", False)),
        cleanup_match_log=bool(_get(raw, "output.cleanup_match_log", False)),
        encoder=raw.get("embeddings") or {},
        encoder_timeout=float(_get(raw, "performance.encoder_call_timeout_ms", 60_000)) / 1000,
        limit=_get(raw, "batch.limit"),
        hooks=_get(raw, "hooks.command"),
    )
    problems = list(_problems(c, raw))
    if problems:
        raise ConfigError("; ".join(problems))
    return c


def _problems(c: Config, raw: dict):
    """What is wrong with a configuration, one message each."""
    if not c.name:
        yield "job.name is missing"
    for s, d in (("a", c.a), ("b", c.b)):
        if not d.path or not d.id_field:
            yield f"datasets.{s} needs path and id_field"
        elif d.kind not in ("csv", "parquet", "jsonl"):
            yield f"datasets.{s}: format must be csv, parquet or jsonl"
    if bool(c.a.common_id_field) != bool(c.b.common_id_field):
        yield "common_id_field must be set on both sides or on neither"
    cross = raw.get("cross_map")
    if cross is not None and (cross.get("backend", "local") != "local" or not c.crossmap_path or not cross.get("a_id_field") or not cross.get("b_id_field")):
        yield "cross_map needs backend local, path, a_id_field and b_id_field"
    if c.exclusions_path and not (c.exclusions_a and c.exclusions_b):
        yield "exclusions need a_id_field and b_id_field"
    if not any(c.output.get(k) for k in ("path", "csv_dir", "parquet_dir", "database", "results_path")):
        yield "output needs a destination"
    if not c.fields:
        yield "match_fields are missing"
    for f in c.fields:
        if f.method not in METHODS:
            yield f"unknown method {f.method!r}"
        if f.weight < 0:
            yield "weights must not be negative"
        if f.method == "bm25" and (f.field_a or f.field_b):
            yield "a bm25 entry has no field_a or field_b"
        if f.method != "bm25" and not (f.field_a and f.field_b):
            yield f"a {f.method} entry needs field_a and field_b"
        if f.method == "fuzzy" and f.scorer not in SCORERS:
            yield f"unknown fuzzy scorer {f.scorer!r}"
    methods = [f.method for f in c.fields]
    if methods.count("bm25") > 1:
        yield "at most one bm25 entry"
    if raw.get("bm25_fields") and any(f.get("fields") for f in raw.get("match_fields") or [] if f.get("method") == "bm25"):
        yield "bm25 fields are either inline or at the top level"
    total = sum(f.weight for f in c.fields if f.method != "synonym")
    if c.fields and abs(total - 1) > 0.01:
        yield f"weights other than synonym's must add up to 1, not {total:g}"
    if "embedding" in methods and c.ann_candidates and c.ann_candidates < c.top_n:
        yield "ann_candidates must be at least top_n"
    if "bm25" in methods and c.bm25_candidates < c.top_n:
        yield "bm25_candidates must be at least top_n"
    if not 0 < c.auto <= 1:
        yield "auto_match must be in (0, 1]"
    if not 0 <= c.floor < 1:
        yield "review_floor must be in [0, 1)"
    if c.auto <= c.floor:
        yield "auto_match must be above review_floor"
    if not 0 <= c.min_gap < 1:
        yield "min_score_gap must be in [0, 1)"
    if "embedding" in methods and bool(c.encoder.get("model")) == bool(c.encoder.get("remote_encoder_cmd")):
        yield "embeddings need exactly one of model and remote_encoder_cmd"
    performance = raw.get("performance") or {}
    for key in ("encoder_pool_size", "encoder_batch_size", "encoder_call_timeout_ms"):
        if performance.get(key) is not None and performance[key] < 1:
            yield f"{key} must be at least 1"
    if c.encoder.get("remote_encoder_cmd") and not performance.get("encoder_pool_size"):
        yield "a remote encoder needs encoder_pool_size"
    if performance.get("quantization", "f32") not in ("f32", "f16", "bf16"):
        yield "quantization must be f32, f16 or bf16"
    if performance.get("index_mode", "load") not in ("load", "mmap"):
        yield "index_mode must be load or mmap"
    if _get(raw, "live.crossmap_flush_secs", 5) < 1:
        yield "the flush interval must be at least 1"
    if c.candidates not in ("generators", "blocked"):
        yield "candidates must be generators or blocked"
    for key, pairs in (("blocking", c.blocking), ("exact_prefilter", c.prefilter)):
        section = raw.get(key) or {}
        if section.get("enabled") and not pairs:
            yield f"{key} needs fields"
        if section.get("operator", "and") != "and":
            yield f"{key}.operator must be and"
    if raw.get("hooks") is not None and not c.hooks:
        yield "hooks.command is empty"
    for s in ("a", "b"):
        for name in c.required(s):
            if not SAFE.match(name):
                yield f"{name!r} is not a safe field name"


def enroll_from_dict(raw: dict) -> dict:
    """An enrolment configuration: one `field` each, on both sides; id_field is required."""
    fields = [MatchField(f["method"], float(f.get("weight", 0)), f.get("field", ""), f.get("field", ""), f.get("scorer") or "wratio") for f in raw.get("match_fields") or []]
    id_field = raw.get("id_field") or _get(raw, "dataset.id_field")
    floor = float(_get(raw, "thresholds.review_floor", 0.6))
    total = sum(f.weight for f in fields if f.method != "synonym")
    if not fields or not id_field or not 0 <= floor < 1 or abs(total - 1) > 0.01:
        raise ConfigError("enrolment needs match_fields with weights that add up to 1, id_field and a review_floor in [0, 1)")
    blocks = [f.get("field", "") for f in _get(raw, "blocking.fields", [])]
    return {"id_field": id_field, "fields": fields, "blocks": blocks, "floor": floor, "top_n": int(raw.get("top_n", 5)), "path": _get(raw, "dataset.path")}
