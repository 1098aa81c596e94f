"""check and fix: documents in, findings and corrected texts out, as lazy tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import refdata
from .operators import extract, fix, rules, suggest
from .operators.progress import Progress


@dataclass
class Engine:
    """Tables given here replace the built-in ones; with join_suggestions misspelled reporters meet them by a join over the distinct ones
    of all documents, instead of once in each task (for large tables, or very many different misspellings); with isolated what fails as it runs is left out, too (see rules.run_rules); authorities, or answers to lookups, turn the VF rules on; notices tell what was left out of a check; progress counts documents, citations and findings while they are made."""

    profile: rules.Profile = field(default_factory=rules.Profile)
    enable: list[str] | None = None
    disable: list[str] | None = None
    authorities: DataFrame | None = None
    lookups: DataFrame | None = None
    join_suggestions: bool = False
    isolated: bool = False
    editions: DataFrame | None = None
    spellings: DataFrame | None = None
    custom: list[rules.Custom] = field(default_factory=list)
    notices: list[str] = field(default_factory=list)
    progress: Progress | None = None

    def citations(self, docs: DataFrame, shapes: bool = False, refused: bool = False) -> DataFrame:
        return extract.citations(docs, extract.reference(docs.sparkSession, self.editions, self.spellings), shapes, refused, self.progress)

    def check(self, docs: DataFrame, cites: DataFrame | None = None) -> DataFrame:
        if cites is None:
            shapes = "RP002" in rules.selected(self.enable, self.disable)
            cites = self.citations(docs, "tokens" if shapes and self.join_suggestions else shapes, refused=True)
            if shapes and self.join_suggestions:
                cites = suggest.with_suggestions(cites, self.editions, self.spellings, self.editions is not None or refdata.listed(docs.sparkSession) is not None)
        found = rules.run_rules(cites, self.profile, self.authorities, self.enable, self.disable, self.editions, self.spellings, self.custom, self.notices, self.lookups, self.isolated)
        return found if self.progress is None else self.progress.observed(found)

    def fix(self, docs: DataFrame, unsafe: bool = False) -> DataFrame:
        return fix.fixed(docs, self.check(docs), unsafe)
