"""Settings of the command-line modes, with their clamps and checks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace

from merloom.functions.codec import H64, H128
from merloom.operators.content import level_or_default
from merloom.sources.tables import read_code_table, read_settings

MIN_ALLOWED, MAX_ALLOWED = 1, 25


@dataclass
class Settings:
    """Defaults are those of the modes; ``checked`` clamps them for an index of h letters."""

    max_k: int = 12
    min_k: int = 7
    beasts: int = 3
    threshold: float = 0.0
    error_threshold: float = 0.5
    coherence_threshold: float = 11.0
    frames: int = 3
    kind: str = "dna"
    level: str = "species"
    unique: bool = False
    coverage: bool = False
    coherence: bool = False
    shrink: int = 2
    percent: float = 0.0
    output: str = "json"
    h: int = H64
    max_k_given: bool = False
    alphabet: str = ""
    alphabet_id: int = 1
    clean: str = "clean"
    contaminated: str = "contaminated"
    gzip: bool = True
    parallel: int = 4
    resume: bool = False

    def checked(self) -> Settings:
        lo, hi = sorted((self.min_k, self.max_k))
        self.min_k, self.max_k = max(MIN_ALLOWED, lo), min(MAX_ALLOWED, hi)
        if self.h == H128 and not self.max_k_given:
            self.max_k = H128
        if self.max_k > self.h:
            warnings.warn(f"the index has {self.h} letters; k is limited to that", stacklevel=2)
            self.max_k = self.h
        self.min_k = min(self.min_k, self.max_k)
        self.beasts = max(1, self.beasts)
        self.level = level_or_default(self.level)
        if self.frames not in (1, 3, 6):
            raise ValueError("one, three or six frames")
        if self.kind not in ("dna", "protein"):
            raise ValueError("dna or protein")
        if self.h not in (H64, H128):
            raise ValueError("12 or 25 letters")
        if self.output not in ("json", "jsonl", "tsv", "short"):
            raise ValueError("json, jsonl, tsv or short")
        return self

    def code_table(self) -> dict[str, str] | None:
        """The codon table of the named alphabet; a missing one is the standard table, with a warning."""
        if not self.alphabet:
            return None
        found = read_code_table(self.alphabet, self.alphabet_id)
        if found is None:
            warnings.warn(f"no code {self.alphabet_id} in {self.alphabet}: the standard code is taken", stacklevel=2)
        return found

    def for_index(self, kind: str, h: int) -> Settings:
        """Settings for an index of that kind: its letters bound k, and a halved one matches at seven letters and more."""
        out = replace(self, h=h)
        if kind == "halved":
            out.min_k, out.max_k = max(7, out.min_k), max(7, out.max_k)
        return out.checked()

    @classmethod
    def from_file(cls, path: str, **over) -> Settings:
        """Flat settings file; unknown keys are ignored, ``over`` wins."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        out = {}
        for k, v in read_settings(path).items():
            k = k.lower().replace("-", "_")
            if k in kinds:
                out[k] = v.lower() in ("1", "true", "yes", "on") if kinds[k] is bool else kinds[k](v)
        out.update(over)
        if "max_k" in out:
            out["max_k_given"] = True
        return cls(**out).checked()
