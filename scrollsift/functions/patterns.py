"""Pattern registry: what to extract, replace, score and detect, from defaults or TOML."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions import text as T


@dataclass(frozen=True)
class EntityPattern:
    type: str
    pattern: str
    confidence: float
    context_window: int
    redact: bool = False
    description: str = ""


@dataclass(frozen=True)
class Tool:
    name: str
    command_patterns: tuple[str, ...]
    entity_hints: tuple[str, ...] = ()
    output_patterns: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Tier1:
    max_occurrences: int = D.MAX_OCCURRENCES
    rules: tuple[tuple[str, str], ...] = tuple((p, r) for _, p, r, _ in D.TIER1)


@dataclass(frozen=True)
class Tier2:
    entropy: float = D.TIER2_WEIGHTS["entropy"]
    uniqueness: float = D.TIER2_WEIGHTS["uniqueness"]
    technical: float = D.TIER2_WEIGHTS["technical"]
    change: float = D.TIER2_WEIGHTS["change"]
    percentile: float = D.PERCENTILE
    max_technical: float = D.MAX_TECHNICAL
    patterns: tuple[tuple[str, float], ...] = tuple((p, w) for _, p, w in D.TECHNICAL)

    def warnings(self) -> list[str]:
        total = self.entropy + self.uniqueness + self.technical + self.change
        return [] if abs(total - 1) < 1e-6 else [f"tier 2 weights sum to {total:g}, not to 1"]


@dataclass(frozen=True)
class Tier3:
    min_size: int = D.CLUSTER_MIN
    max_size: int = D.CLUSTER_MAX
    strategy: str = D.STRATEGY
    rules: tuple[tuple[str, str], ...] = tuple((p, r) for _, p, r in D.TIER3)

    def chosen(self) -> str:
        """Strategies are named in any case; an unknown name means highest entropy."""
        name = self.strategy.lower()
        return name if name in ("first", "longest") else "highest_entropy"


@dataclass(frozen=True)
class Registry:
    entities: tuple[EntityPattern, ...] = tuple(EntityPattern(*e) for e in D.ENTITIES)
    tools: tuple[Tool, ...] = tuple(Tool(n, tuple(c), tuple(h), tuple(o)) for n, c, h, o in D.TOOLS)
    tier1: Tier1 = field(default_factory=Tier1)
    tier2: Tier2 = field(default_factory=Tier2)
    tier3: Tier3 = field(default_factory=Tier3)

    def __post_init__(self) -> None:
        """Any pattern that doesn't compile fails the load."""
        for pattern in self.patterns():
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"bad pattern {pattern!r}: {e}") from e

    def check(self, spark) -> None:
        """Compile every pattern by Spark's own regular expressions, which differ in places."""
        one = spark.range(1).select(F.lit("").alias("t"))
        for pattern in self.patterns():
            try:
                one.select(F.regexp_count("t", F.lit(pattern))).collect()
            except Exception as e:
                raise ValueError(f"bad pattern {pattern!r} for Spark: {e}") from e

    def patterns(self) -> list[str]:
        return [
            *(e.pattern for e in self.entities),
            *(c for t in self.tools for c in t.command_patterns),
            *(o for t in self.tools for o, _ in t.output_patterns),
            *(p for p, _ in (*self.tier1.rules, *self.tier2.patterns, *self.tier3.rules)),
        ]

    def normalize_tier1(self, line: Column) -> Column:
        return T.normalize(line, self.tier1.rules)

    def normalize_tier3(self, line: Column) -> Column:
        return T.normalize(line, self.tier3.rules)

    def technical(self, line: Column) -> Column:
        return T.technical_score(line, self.tier2.patterns, self.tier2.max_technical)

    def detect_tool(self, command: Column) -> Column:
        """First tool in file order with any matching command pattern, else null."""
        hit = lambda t: reduce(lambda a, b: a | b, [command.rlike(p) for p in t.command_patterns])
        return F.coalesce(*[F.when(hit(t), F.lit(t.name)) for t in self.tools])

    def sections(self, tool: Column, line: Column) -> Column:
        """Names of the output sections of a tool whose pattern a line matches."""
        named = [F.when((tool == t.name) & line.rlike(p), F.lit(s)) for t in self.tools for p, s in t.output_patterns]
        return F.array_compact(F.array(*named))


def load(entities: str, tools: str, filters: str) -> Registry:
    """Registry of three TOML files. Tier-1 rules are sorted by priority, stably."""
    read = lambda p: tomllib.loads(Path(p).read_text(encoding="utf-8"))
    e, t, f = read(entities), read(tools), read(filters)
    t1, t2, t3 = f["tier1"], f["tier2"], f["tier3"]
    rules = sorted(t1["normalization_patterns"], key=lambda r: r["priority"])
    return Registry(
        tuple(EntityPattern(x["type"], x["pattern"], x["confidence"], x["context_window"], x.get("redact", False), x.get("description", "")) for x in e["entity"]),
        tuple(
            Tool(x["name"], tuple(x["command_patterns"]), tuple(x.get("entity_hints", ())), tuple((o["pattern"], o["section"]) for o in x.get("output_patterns", ())))
            for x in t["tool"]
        ),
        Tier1(t1["max_occurrences"], tuple((r["pattern"], r["replacement"]) for r in rules)),
        Tier2(
            t2["entropy_weight"], t2["uniqueness_weight"], t2["technical_weight"], t2["change_weight"],
            t2["score_threshold_percentile"], t2["max_technical_score"], tuple((r["pattern"], r["weight"]) for r in t2["technical_patterns"]),
        ),
        Tier3(t3["cluster_min_size"], t3["max_cluster_size"], t3["representative_strategy"], tuple((r["pattern"], r["replacement"]) for r in t3["cluster_patterns"])),
    )


def _toml(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return "'" + value + "'" if "'" not in value else '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _table(name: str, rows: list[dict]) -> str:
    return "".join(f"[[{name}]]\n" + "".join(f"{k} = {_toml(v)}\n" for k, v in row.items()) + "\n" for row in rows)


def install_templates(folder: str, force: bool = False) -> list[str]:
    """Write the default patterns as TOML files; existing files stay unless forced."""
    filters = (
        f"[tier1]\nmax_occurrences = {D.MAX_OCCURRENCES}\n\n"
        + _table("tier1.normalization_patterns", [dict(zip(("name", "pattern", "replacement", "priority"), r, strict=True)) for r in D.TIER1])
        + "[tier2]\n"
        + "".join(f"{k}_weight = {v}\n" for k, v in D.TIER2_WEIGHTS.items())
        + f"score_threshold_percentile = {D.PERCENTILE}\nmax_technical_score = {D.MAX_TECHNICAL}\n\n"
        + _table("tier2.technical_patterns", [dict(zip(("name", "pattern", "weight"), r, strict=True)) for r in D.TECHNICAL])
        + f"[tier3]\ncluster_min_size = {D.CLUSTER_MIN}\nmax_cluster_size = {D.CLUSTER_MAX}\nrepresentative_strategy = '{D.STRATEGY}'\n\n"
        + _table("tier3.cluster_patterns", [dict(zip(("name", "pattern", "replacement"), r, strict=True)) for r in D.TIER3])
    )
    entities = _table("entity", [dict(zip(("type", "pattern", "confidence", "context_window", "redact"), e, strict=True)) for e in D.ENTITIES])
    tools = ""
    for name, commands, hints, outputs in D.TOOLS:
        tools += _table("tool", [{"name": name, "command_patterns": commands, "entity_hints": hints}])
        tools += _table("tool.output_patterns", [{"pattern": p, "section": s} for p, s in outputs])
    done = []
    for name, body in (("entities.toml", entities), ("tools.toml", tools), ("filters.toml", filters)):
        path = Path(folder) / name
        if force or not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(body, encoding="utf-8")
            done.append(str(path))
    return done
