"""Logging on the driver: to the terminal, and to files if there is a folder for them."""

from __future__ import annotations

import datetime as dt
import logging
import sys
from logging.handlers import RotatingFileHandler
from pathlib import Path


def setup_logging(level: str = "info", folder: str | None = None) -> logging.Logger:
    """The engine's logger. In ``folder``: a file for the run, and one for statements that is renewed at 5 MB."""
    log = logging.getLogger("tabloom")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel(level.upper())
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder) / f"run-{dt.datetime.now():%Y%m%d-%H%M%S}.log", encoding="utf-8"))
        statements = logging.getLogger("tabloom.sql")
        for h in list(statements.handlers):
            statements.removeHandler(h)
            h.close()
        own = RotatingFileHandler(Path(folder) / "sql.log", maxBytes=5 << 20, backupCount=3, encoding="utf-8")
        own.setFormatter(form)
        statements.addHandler(own)
        statements.propagate = False
    for h in handlers:
        h.setFormatter(form)
        log.addHandler(h)
    return log
