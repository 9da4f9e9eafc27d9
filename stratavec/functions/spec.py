"""What an index is made of: dimensions, tiers, code kind, and the fixed signs of the transform."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ONE_BIT, TWO_BIT, FLOAT = 0, 1, 2
WORD = 64


class UnsupportedLayout(ValueError):
    """A layout or mode that an operation cannot work with."""


def rademacher(n: int, seed: int = 42) -> np.ndarray:
    """The first n signs of the 48-bit linear congruential generator that java.util.Random documents; a longer list starts the same."""
    state, out = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), []
    for _ in range(n):
        state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        out.append(1.0 if state >> 47 else -1.0)
    return np.array(out)


def default_tiers(dim: int) -> list[int]:
    """A tier layout for a dimension: one tier up to 64, else the powers of two below it (512 only beyond 384 dimensions)."""
    if dim <= WORD:
        return [dim]
    return [t for t in (64, 128, 256, 512) if t < dim and (t < 512 or dim > 384)] + [dim]


@dataclass(frozen=True)
class IndexSpec:
    """tiers are ascending cumulative boundaries, the last at most dim; dimensions beyond it are stored only in the half vector."""

    dim: int
    tiers: tuple[int, ...] = ()
    q_mode: int = ONE_BIT
    half: bool = True
    planet_id: int = 0
    radius: int = 0
    signs: tuple[float, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        tiers = tuple(self.tiers) or tuple(default_tiers(self.dim))
        object.__setattr__(self, "tiers", tiers)
        object.__setattr__(self, "signs", tuple(self.signs) or tuple(rademacher(self.dim).tolist()))
        if self.dim < 1 or not 1 <= len(tiers) <= 8 or tiers[0] < 1 or tiers[-1] > self.dim or any(a >= b for a, b in zip(tiers, tiers[1:], strict=False)):
            raise UnsupportedLayout(f"tiers {tiers} don't fit {self.dim} dimensions")
        if self.q_mode not in (ONE_BIT, TWO_BIT, FLOAT):
            raise UnsupportedLayout(f"code kind {self.q_mode}")
        if len(self.signs) != self.dim:
            raise UnsupportedLayout("as many signs as dimensions are needed")

    @property
    def widths(self) -> list[int]:
        return [b - a for a, b in zip((0, *self.tiers), self.tiers, strict=False)]

    @property
    def words(self) -> list[tuple[int, int, int]]:
        """Of each 64-bit word: its tier, and the range of dimensions. A tier starts a word of its own, so narrow tiers work too."""
        out, low = [], 0
        for k, high in enumerate(self.tiers):
            out += [(k, a, min(a + WORD, high)) for a in range(low, high, WORD)]
            low = high
        return out

    def code_columns(self, last_tier: int | None = None) -> list[str]:
        """The code columns of the tiers up to last_tier."""
        last = len(self.tiers) - 1 if last_tier is None else last_tier
        if self.q_mode == FLOAT:
            return [f"t{k}" for k in range(last + 1)]
        kinds = "w" if self.q_mode == ONE_BIT else "sm"
        return [f"{c}{i}" for c in kinds for i, (k, _, _) in enumerate(self.words) if k <= last]
