"""Settings of a linkage run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LinkageConfig:
    """attrs: compared columns, in order; key_attrs: columns of the exact-duplicate key (attrs, if empty).

    thresholds: largest edit distance by attribute; total: of all attributes together.
    block_attr: position in attrs of the attribute that blocks are built from.
    key_mode: "parity" (concatenation without separators, trailing zeros ignored) or "strict" (tuples).
    headless: "all_pairs" or "adjacent"; candidates: "block" or "exact".
    token_gate: pairs must also agree on the attribute clusters of every attribute.
    """

    attrs: tuple[str, ...]
    thresholds: tuple[int, ...]
    total: int = 1
    block_attr: int = 0
    k: int = 3
    key_attrs: tuple[str, ...] = ()
    key_mode: str = "parity"
    headless: str = "all_pairs"
    candidates: str = "block"
    token_gate: bool = False

    def __post_init__(self):
        if len(self.attrs) != len(self.thresholds) or not self.attrs:
            raise ValueError("one threshold for each attribute is needed")
        if not 0 <= self.block_attr < len(self.attrs):
            raise ValueError("block_attr is a position in attrs")
        for value, allowed in (
            (self.key_mode, ("parity", "strict")), (self.headless, ("all_pairs", "adjacent")), (self.candidates, ("block", "exact")),
        ):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")

    @property
    def keys(self) -> tuple[str, ...]:
        return self.key_attrs or self.attrs
