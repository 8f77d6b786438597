"""Runnable jobs. Each module has a function that takes a session and plain paths, and a command line around it."""
