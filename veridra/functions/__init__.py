"""Part of veridra."""
