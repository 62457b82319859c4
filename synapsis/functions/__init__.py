"""Column expressions."""

from .kinetics import hill, hill_inverse, hill_lut, log_normalized, none_if_blank, register, safe_ratio

__all__ = ["hill", "hill_inverse", "hill_lut", "log_normalized", "none_if_blank", "register", "safe_ratio"]
