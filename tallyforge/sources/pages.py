"""Pages of PDF files as images, by a program beside Spark. Each task draws in a folder of its own that is gone afterwards."""

from __future__ import annotations

import subprocess
import tempfile
from pathlib import Path

DPI = 150


class NoPages(Exception):
    """The program is missing, failed, or drew nothing."""


def rasterize(pdf: bytes, pages: int, program: str = "pdftoppm", dpi: int = DPI, timeout: int = 120) -> list[bytes]:
    """The first pages as PNG files, in order, however the program numbers them."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "in.pdf").write_bytes(pdf)
        try:
            done = subprocess.run([program, "-r", str(dpi), "-l", str(pages), "-png", "in.pdf", "out"], cwd=folder, capture_output=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise NoPages(str(e)) from e
        if done.returncode:
            raise NoPages(done.stderr.decode("utf-8", "replace")[-500:])
        drawn = sorted(Path(folder).glob("out*.png"), key=lambda p: int("".join(c for c in p.stem if c.isdigit()) or 0))
        if not drawn:
            raise NoPages("nothing was drawn")
        return [p.read_bytes() for p in drawn]
