"""factorlab: cross-sectional factor research expressed as Spark DataFrame plans."""

from factorlab.config import EngineConfig, StrategySpec

__all__ = ["EngineConfig", "StrategySpec"]
