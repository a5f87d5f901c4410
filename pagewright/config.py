"""Thresholds and weights that change results, overridable one by one."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of every threshold.  ``from_conf`` reads overrides named ``pagewright.<field>``."""

    # Page routing.
    primary_confidence: float = 0.85
    quality_threshold: float = 0.70
    retry_variants: bool = True
    variant_attempts: int = 2
    merge_iou: float = 0.30
    script_share: float = 0.10
    # Layout and suppression.
    heading_words: int = 8
    heading_height: float = 30.0
    column_overlap: float = 0.5
    containment: float = 0.6
    duplicate_iou: float = 0.5
    duplicate_similarity: float = 0.85
    caption_gap: float = 80.0
    crop_padding: int = 10
    # Review.
    accept_confidence: float = 0.90
    flag_confidence: float = 0.75
    figure_confidence: float = 0.85
    low_page_confidence: float = 0.8
    # Quality weights.
    weight_confidence: float = 0.35
    weight_text: float = 0.25
    weight_characters: float = 0.15
    weight_coverage: float = 0.15
    weight_language: float = 0.10
    # Correction.
    provider: str = "none"
    skip_confidence: float = 0.98
    max_edit_ratio: float = 0.30
    requests_per_minute: int = 5
    rate_limit_waits: int = 3
    honored_delay: float = 60.0
    server_attempts: int = 5
    initial_delay: float = 1.0
    max_delay: float = 30.0
    cooldown_minutes: int = 30
    spell_confidence: float = 0.90
    # Rasterising and uploads.
    dpi: int = 200
    longest_edge: int = 2200
    upload_bytes: int = 50 * 1024 * 1024

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Settings:
        """Settings with the session's overrides."""
        out = cls()
        for f in fields(cls):
            value = spark.conf.get(f"pagewright.{f.name}", None)
            if value is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: value.lower() == "true" if kind is bool else kind(value)})
        return out


DEFAULT = Settings()
#: Fixed value: types that carry no running text.
STRUCTURE_TYPES = ("table", "figure")
#: Fixed value: types that quality is measured on.
TEXT_TYPES = ("paragraph", "heading", "list")
