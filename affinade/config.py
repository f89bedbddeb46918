"""Settings of an experiment; every operator takes what it needs as plain arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    seed: int = 42
    test_frac: float = 0.2
    val_frac: float = 0.1
    k: int = 10
    relevant_from: float = 4.0
    liked_from: float = 4.0
    min_support: int = 3
    beta: float = 25.0
    hide_frac: float = 0.3
    hide_keep: int = 5
    head_mass: float = 1 / 3
    medium_mass: float = 2 / 3


CONFIG = Config()


def digits(text: str) -> int:
    """The digits of a text as one number."""
    found = "".join(c for c in text if c.isdigit())
    if not found:
        raise ValueError(f"no digit in {text!r}")
    return int(found)


def target_user(text: str, n_users: int) -> int:
    """A user number from 1 to ``n_users`` for a text with digits."""
    return digits(text) % n_users + 1
