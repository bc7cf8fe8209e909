"""Parameters of the codec and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CodecParams:
    """tile: samples a dictionary window spans; range_size and domain_step default to what it implies.

    query_mode: embed ranges ("range") or search range i with the embedding of domain i
    ("domain_alias"). silence_mode: a range below the energy floor gets no domain ("sentinel") or
    domain 0 with infinite error ("domain0"). scale_mode: decode with "refit" or "stored" scales.
    search_mode: "exact" for many short signals, "blocked" (exact too) and "cells" (approximate, with
    `probes` cells a range) for few long ones.
    """

    tile: int = 1024
    range_size: int | None = None
    domain_step: int | None = None
    emb_dim: int = 16
    top_k: int = 32
    energy_threshold: float = 1e-4
    smooth_window: int = 5
    s_clip: float = 16.0
    s_damping: float = 0.0
    iterations: int = 8
    eps: float = 1e-3
    query_mode: str = "range"
    silence_mode: str = "sentinel"
    scale_mode: str = "refit"
    search_mode: str = "exact"
    probes: int = 16
    mask: bool = True

    def __post_init__(self):
        for name, allowed in (("query_mode", ("range", "domain_alias")), ("silence_mode", ("sentinel", "domain0")), ("scale_mode", ("refit", "stored")), ("search_mode", ("exact", "blocked", "cells"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.emb_dim % 2:
            raise ValueError("emb_dim must be even: half of it is tonal, half transient")

    @property
    def R(self) -> int:  # noqa: N802
        return self.range_size or max(4, self.tile // 256)

    @property
    def step(self) -> int:
        return self.domain_step or max(1, self.R // 4)

    @property
    def block(self) -> int:
        """Samples averaged into one element of a domain."""
        return self.tile // self.R

    @property
    def frame(self) -> int:
        """Samples of a voice-activity frame."""
        return 2 * self.R

    def n_ranges(self, n: int) -> int:
        return -(-n // self.R)

    def n_domains(self, n: int) -> int:
        return 0 if n < self.tile else (n - self.tile) // self.step + 1
