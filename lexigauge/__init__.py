"""Text similarity in a vector space, and its evaluation against people, as Spark jobs."""

from lexigauge.config import ModelConfig, sweep_configs

__all__ = ["ModelConfig", "sweep_configs"]
