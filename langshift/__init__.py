"""Social influence on language use, expressed as Spark DataFrame jobs."""

from langshift.config import PRESETS, Variant
from langshift.plans.study import Study

__all__ = ["PRESETS", "Study", "Variant"]
