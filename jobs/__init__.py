"""Runnable jobs: python -m jobs.<name> --help."""
