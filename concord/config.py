"""Defaults of the operators, in one place."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    repetitions: int = 5
    top_k: int = 5
    k_range: tuple[int, ...] = tuple(range(2, 16))
    attempts: int = 3
    backoff: float = 1.5
    summary_rows: int = 20
    reference_draws: int = 10
    reference_image: str = "he.png"
    #: Clusters that one task links or cuts; more of them are first merged in distributed rounds.
    local_clusters: int = 1024
    #: Rows that silhouette and gap look at, where a sample is asked for, and its seed.
    sample_rows: int = 5000
    sample_seed: int = 2025
    #: Competitors whose names the driver may hold.
    max_models: int = 10_000


DEFAULTS = Defaults()
