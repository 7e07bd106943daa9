"""Runnable jobs: ``python -m jobs.<name> --input TABLES --output FOLDER [--config FILE]``."""
