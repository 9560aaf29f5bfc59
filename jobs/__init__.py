"""Runnable jobs over the engine: each module has a function that takes a session, and a command line with a settings file."""
