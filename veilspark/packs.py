"""Packs: what a country brings along (tags, thresholds, patterns, checks), under one name; detectors; the state of it all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import contract
from .functions.plain import CHECKS
from .operators.recognise import DETECTORS, RULES, Rule


@dataclass(frozen=True)
class Pack:
    name: str
    tags: tuple[contract.Tag, ...] = contract.TAGS
    rules: dict[str, Rule] = field(default_factory=lambda: dict(RULES))
    checks: dict[str, Callable[[str], bool]] = field(default_factory=lambda: dict(CHECKS))

    @property
    def actions(self) -> dict[str, str]:
        return {t.name: t.action for t in self.tags}

    @property
    def thresholds(self) -> dict[str, float]:
        return dict(contract.THRESHOLDS)

    @property
    def placeholders(self) -> dict[str, str]:
        return {t.name: t.name for t in self.tags}

    @property
    def labels(self) -> tuple[str, ...]:
        return contract.bio_labels()

    @property
    def label_hash(self) -> str:
        return contract.label_hash()

    def findings(self) -> list[str]:
        """What is wrong with the pack: the contract's own rules, patterns of unknown tags, checks that are missing, and two
        tags under one placeholder."""
        names = {t.name for t in self.tags}
        out = contract.check(self.tags)
        out += [f"{key}: unknown tag {r.tag}" for key, r in self.rules.items() if r.tag not in names]
        out += [f"{key}: no check {r.validator}" for key, r in self.rules.items() if r.validator and r.validator not in self.checks]
        own = list(self.placeholders.values())
        return out + [f"placeholder {p} twice" for p in sorted(set(own)) if own.count(p) > 1]


_PACKS: dict[str, Callable[[], Pack]] = {"ch": lambda: Pack("ch")}


def register(name: str, make: Callable[[], Pack]) -> None:
    _PACKS[name] = make


def load_pack(name: str = "ch") -> Pack:
    """A pack by name, if it is known and sound."""
    if name not in _PACKS:
        raise ValueError(f"unknown pack {name!r}, known: {sorted(_PACKS)}")
    pack = _PACKS[name]()
    if found := pack.findings():
        raise ValueError(f"pack {name!r}: {found}")
    return pack


def state(pack: Pack | None = None) -> dict:
    """What a service says about itself."""
    own = pack or load_pack()
    return {"pack": own.name, "tags": len(own.tags), "labels": len(own.labels), "label_hash": own.label_hash, "patterns": len(own.rules), "checks": sorted(own.checks), "detectors": sorted(DETECTORS)}


def tags(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """The tag table with display names (by default the tag itself) for a language's names."""
    shown = F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair])
    return contract.tag_table(spark).withColumn("display", F.coalesce(F.element_at(shown, F.col("tag")), F.col("tag")))


def readable(saved: set[str], now: set[str], consent: bool = False) -> set[str]:
    """Tags to be left readable: those saved and those of this run together, checked by the contract."""
    return contract.excluded_tags(saved | now, consent)
