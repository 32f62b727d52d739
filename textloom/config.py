"""Constant tables and options of the pipelines."""

from dataclasses import dataclass

MARGIN = 0.03

#: Decision profiles by sensitivity (fixed values).
SENSITIVITY = {
    "low": {"review": 0.72, "flag": 0.88, "review_uncertainty": 0.60, "flag_uncertainty": 0.30, "content_min": 0.55, "human_max": 0.35},
    "medium": {"review": 0.65, "flag": 0.85, "review_uncertainty": 0.60, "flag_uncertainty": 0.35, "content_min": 0.45, "human_max": 0.45},
    "high": {"review": 0.55, "flag": 0.75, "review_uncertainty": 0.62, "flag_uncertainty": 0.45, "content_min": 0.0, "human_max": 0.55},
}


def profile(sensitivity: str | None) -> dict[str, float]:
    """The profile of a sensitivity; that of medium for an unknown one."""
    return SENSITIVITY.get((sensitivity or "").strip().lower(), SENSITIVITY["medium"])


@dataclass(frozen=True)
class EngineConfig:
    """Options of a detection run."""

    use_perplexity: bool = True
    use_stylometry: bool = True
    sensitivity: str = "medium"
    sentence_target: int = 200
    sentence_most: int = 300
    academic: float = 0.0
    noise: str = "none"
    lines_as_paragraphs: bool = False
