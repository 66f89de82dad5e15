"""Runnable jobs over the library: ``python -m jobs.monitor_events`` and ``python -m jobs.screen_documents``."""
