"""What of a repository is read: defaults, presets, lenient loading."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

# Extensions of text files, and what presets leave out.
TEXT_EXTENSIONS = tuple(
    ".md .mdx .ts .tsx .js .jsx .mjs .cjs .json .yaml .yml .txt .css .scss .sass .less .html .graphql .gql .py .java .kt .kts .go .rs .rb .php .cs .sh .zsh .bash .toml .ini .conf .sql .xml".split()
)
DEFAULT_EXCLUDE = "**/node_modules/** **/.git/** **/.nx/** **/dist/** **/coverage/** **/.next/** **/.turbo/** **/build/** **/.cache/** **/*.min.* **/*.lock **/pnpm-lock.yaml **/package-lock.json **/yarn.lock".split()
PRESET_EXCLUDE = {
    "generic": "**/node_modules/** **/.git/** **/dist/** **/coverage/** **/.cache/** **/*.min.* **/pnpm-lock.yaml **/package-lock.json **/yarn.lock".split(),
    "nx": "**/node_modules/** **/.git/** **/.nx/** **/dist/** **/coverage/** **/.next/** **/.turbo/** **/build/** **/.cache/** **/*.min.* **/pnpm-lock.yaml **/package-lock.json **/yarn.lock".split(),
    "nextjs": "**/node_modules/** **/.git/** **/.next/** **/out/** **/dist/** **/coverage/** **/.turbo/** **/*.min.* **/pnpm-lock.yaml **/package-lock.json **/yarn.lock".split(),
    "python": "**/.git/** **/.venv/** **/venv/** **/__pycache__/** **/.pytest_cache/** **/.mypy_cache/** **/dist/** **/build/** **/*.pyc".split(),
}
#: Files and folders that tell a preset, in the order they are tried.
MARKERS = {"nx": ("nx.json", ".nx"), "nextjs": ("next.config.js", "next.config.ts", "next.config.mjs"), "python": ("requirements.txt", "pyproject.toml", "setup.py")}


@dataclass
class SnapshotConfig:
    preset: str = "generic"
    mode: str = "full"
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDE))
    text_extensions: list[str] = field(default_factory=lambda: list(TEXT_EXTENSIONS))
    max_files: int = 0
    max_file_chars: int = 4000

    def row_hash(self) -> str:
        """Of what a snapshot's rows are made with; which files there are is told by the listing."""
        return hashlib.sha256(json.dumps([self.mode, self.max_file_chars]).encode()).hexdigest()

    @classmethod
    def for_preset(cls, preset: str) -> SnapshotConfig:
        return cls(preset=preset, exclude=list(PRESET_EXCLUDE.get(preset, PRESET_EXCLUDE["generic"])))

    @classmethod
    def load(cls, *paths: str) -> SnapshotConfig:
        """From the first JSON file that exists; fields of the wrong type keep their defaults, and
        so does everything if the file can't be read."""
        out = cls()
        for path in map(Path, paths):
            if not path.exists():
                continue
            try:
                given = json.loads(path.read_text())
            except (OSError, ValueError):
                return out
            names = {"textExtensions": "text_extensions", "maxFiles": "max_files", "maxFileChars": "max_file_chars"}
            for key, value in given.items() if isinstance(given, dict) else ():
                name = names.get(key, key)
                if name in out.__dict__ and type(value) is type(getattr(out, name)):
                    setattr(out, name, value)
            return out
        return out


def detect_preset(paths: list[str]) -> str:
    """The preset by the names at a repository's root."""
    found = set(paths)
    return next((preset for preset, markers in MARKERS.items() if found & set(markers)), "generic")
