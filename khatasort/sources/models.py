"""Model files from outside, with their checksums."""

from __future__ import annotations

import hashlib
import subprocess
import urllib.request
from pathlib import Path


class ChecksumError(ValueError):
    """A downloaded file isn't the one that was pinned."""


def sha256_of(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def fetch(url: str, folder: str, sha256: str) -> Path:
    """Download a file into a folder and check it; it gets its name only once it is right.  A right file is left alone."""
    target = Path(folder) / url.rstrip("/").rsplit("/", 1)[-1]
    if target.exists() and sha256_of(target) == sha256:
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    try:
        with urllib.request.urlopen(url) as source, part.open("wb") as out:  # noqa: S310
            while block := source.read(1 << 20):
                out.write(block)
        if (got := sha256_of(part)) != sha256:
            raise ChecksumError(f"{url}: SHA-256 is {got}, not {sha256}")
        part.rename(target)
    finally:
        part.unlink(missing_ok=True)
    return target


def provenance(*files: str) -> dict:
    """What an evaluation ran on: the code's commit (None outside a repository) and the files' checksums."""
    here = Path(__file__).resolve().parent
    told = subprocess.run(["git", "-C", str(here), "describe", "--always", "--dirty"], capture_output=True, text=True, check=False)  # noqa: S603, S607
    return {"code": told.stdout.strip() or None, "files": {Path(f).name: sha256_of(Path(f))[:12] for f in files if Path(f).is_file()}}
