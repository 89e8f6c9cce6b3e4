"""Query plans over derived graph tables."""
