"""What to search for, and where: the search specification, its settings file, and the plan-time decisions taken from it."""

from __future__ import annotations

import json
import os
import posixpath
from dataclasses import asdict, dataclass, field, fields, replace

#: The extensions of each family of files.
FAMILIES = {
    "excel": (".xlsx", ".xlsm", ".xls"),
    "word": (".docx", ".docm", ".doc"),
    "powerpoint": (".pptx", ".pptm", ".ppt"),
    "pdf": (".pdf",),
    "text": (".txt",),
}
EXCEL = FAMILIES["excel"]
SLOTS = 5


class SpecError(ValueError):
    """A search that cannot be run as it is stated."""


def parse_extensions(text: str | None) -> list[str]:
    """Extensions from a list divided by commas, semicolons or blanks: lower case, with a leading dot, each once."""
    found: list[str] = []
    for part in (text or "").replace(",", " ").replace(";", " ").split(" "):
        part = part.strip().lower()
        if part:
            part = part if part.startswith(".") else "." + part
            if part not in found:
                found.append(part)
    return found


def absolute(path: str, base: str) -> str:
    """An absolute path, or a URI as it is; a relative path lies in `base`, which may be a URI. file: URIs are plain paths."""
    for name in (path, base):
        if name.startswith("file:/"):
            return absolute(path.removeprefix("file://").removeprefix("file:"), base.removeprefix("file://").removeprefix("file:"))
    if "://" in path:
        return path
    if "://" in base and not path.startswith("/"):
        return posixpath.join(base, path)
    return os.path.abspath(os.path.join(base, path))


def normalize_folders(text: str | None, base: str) -> list[str]:
    """Folders from a list divided by semicolons: absolute (relative ones lie in `base`), with a final separator, each once whatever its case."""
    found: dict[str, str] = {}
    for part in (text or "").split(";"):
        part = part.strip()
        if part:
            full = absolute(part, base).rstrip(os.sep) + os.sep
            found.setdefault(full.lower(), full)
    return list(found.values())


@dataclass(frozen=True)
class Keyword:
    """A slot of the search form."""

    keyword: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class SearchSpec:
    """A search. Keywords match a part of an entry; with match_all, all active ones must."""

    keywords: tuple[Keyword, ...] = field(default_factory=lambda: (Keyword(),) * SLOTS)
    match_all: bool = True
    case_sensitive: bool = False
    regex: bool = False
    target: str = ""
    excel: bool = True
    word: bool = True
    powerpoint: bool = True
    pdf: bool = True
    text: bool = True
    include_all: bool = False
    custom_enabled: bool = False
    custom_extensions: str = ""
    exclude_enabled: bool = False
    exclude_extensions: str = ""
    exclude_folders_enabled: bool = False
    exclude_folders: str = ""
    formulas: bool = False
    remove_line_breaks: bool = False
    live: bool = False
    #: None: no cache of extracted entries.
    cache: str | None = None
    rebuild_cache: bool = False
    #: Write the conditions of the search above exports.
    export_conditions: bool = False

    @classmethod
    def of(cls, *keywords: str, **more) -> SearchSpec:
        return cls(tuple(Keyword(k) for k in keywords), **more)

    def active(self) -> list[str]:
        """Enabled keywords that are not blank, as typed."""
        return [k.keyword for k in self.keywords if k.enabled and k.keyword.strip()]

    def included(self) -> list[str]:
        """Extensions to read; none stands for all of them if include_all, else for no file."""
        if self.include_all:
            return []
        found = [x for family, on in (("excel", self.excel), ("word", self.word), ("powerpoint", self.powerpoint), ("pdf", self.pdf), ("text", self.text)) if on for x in FAMILIES[family]]
        if self.custom_enabled:
            found += [x for x in parse_extensions(self.custom_extensions) if x not in found]
        return found

    def excluded(self) -> list[str]:
        return parse_extensions(self.exclude_extensions) if self.exclude_enabled else []

    def skipped_folders(self) -> list[str]:
        """Folders not to enter; the cache's own is always among them."""
        base = self.root()
        found = normalize_folders(self.exclude_folders, base) if self.exclude_folders_enabled else []
        if self.cache:
            found.append(absolute(self.cache, os.getcwd()).rstrip(os.sep) + os.sep)
        return found

    def root(self, base: str | None = None) -> str:
        """The folder to search, absolute, or its URI; a relative one lies in `base`."""
        return absolute(self.target, base or os.getcwd())

    def nothing_to_do(self) -> bool:
        """Searches that have no result whatever the files hold."""
        return not self.active() or not self.target.strip() or (not self.included() and not self.include_all)

    def accepts(self, extension: str) -> bool:
        extension = extension.lower()
        return extension not in self.excluded() and (self.include_all or extension in self.included())

    def validate_form(self) -> list[str]:
        """What a user must still fill in."""
        missing = []
        if not self.target.strip():
            missing.append("target folder")
        if not self.active():
            missing.append("keyword")
        if not (self.include_all or self.custom_enabled or self.excel or self.word or self.powerpoint or self.pdf or self.text):
            missing.append("file type")
        return missing


def save(spec: SearchSpec, path: str) -> bool:
    """Write the settings as JSON; False if that fails."""
    try:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(spec), f, ensure_ascii=False, indent=1)
    except OSError:
        return False
    return True


def load(path: str, default_target: str | None = None) -> SearchSpec:
    """Settings from a JSON file; the defaults where it is absent or broken. An empty target becomes the default one."""
    spec = SearchSpec()
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        known = {x.name for x in fields(SearchSpec)}
        found = {k: v for k, v in found.items() if k in known}
        if "keywords" in found:
            found["keywords"] = tuple(Keyword(str(k["keyword"]), bool(k["enabled"])) for k in found["keywords"])
        spec = replace(spec, **found)
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        spec = SearchSpec()
    if not spec.target.strip():
        spec = replace(spec, target=default_target or os.path.expanduser("~"))
    return spec
