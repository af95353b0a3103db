"""Project files: which folders and files a project has, and which of them it takes."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from tessera.plans.pattern import compile_pattern

# Languages and their file endings in a new project file.
LANGUAGES = {
    "C/C++": "cpp|cxx|cc|c|hpp|hxx|hh|h|inl",
    "C#, VB.NET": "cs|vb",
    "CMake": "cmake",
    "D": "d",
    "Delphi, Pascal": "dpr|pas|pp|inc|dfm|lfm|lpi|lpr|dpk|dproj|spp",
    "F#, OCaml, Haskell": "fs|fsi|fsx|ml|mli|hs",
    "Go": "go",
    "HTML, CSS": "htm|html|css|sass|scss",
    "Java, JavaScript, Kotlin, TypeScript": "java|js|kt|kts|ts|tsx",
    "Julia": "jl",
    "Lua, Squirrel": "lua|nut",
    "Markdown, reStructuredText, simple text": "md|rst|txt",
    "Nim": "nim",
    "Objective C/C++": "m|mm",
    "Perl, Python, Ruby": "pl|py|pm|rb",
    "PHP, ActionScript": "php|as",
    "Rust": "rs",
    "Shaders": "hlsl|glsl|cg|fx|cgfx",
    "XML, JSON, CSV": "xml|json|csv",
    "Zig": "zig",
}


class ConfigError(ValueError):
    """A project file that can't be read, with its line."""


@dataclass
class Group:
    parent: "Group | None" = None
    paths: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    groups: list["Group"] = field(default_factory=list)

    def walk(self) -> Iterator["Group"]:
        yield self
        for g in self.groups:
            yield from g.walk()


def normal_path(base: str, path: str) -> str:
    """``path`` from ``base`` with slashes only and no ``.`` or ``..``; drives and shares stay in front."""
    path, base = path.replace("\\", "/"), base.replace("\\", "/")
    if not (path.startswith("/") or path[1:3] == ":/"):
        path = f"{base}/{path}" if base else path
    head = "//" if path.startswith("//") else ""
    out = posixpath.normpath(path)
    out += "/" * (len(out) == 2 and out[1] == ":")
    return head + out.lstrip("/") if head else out


def parse_config(text: str, base: str, name: str = "project") -> Group:
    """The root group of a project file's text; paths are relative to ``base``."""
    root = at = Group()
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip(" \t\r")
        if not line or line.startswith("#"):
            continue
        word, *rest = line.split(None, 1)
        rest = rest[0] if rest else ""
        try:
            if word in ("path", "file"):
                if not rest:
                    raise ConfigError("no path")
                (at.paths if word == "path" else at.files).append(normal_path(base, rest))
            elif word in ("include", "exclude"):
                compile_pattern(rest, ignore_case=True)
                (at.include if word == "include" else at.exclude).append(rest)
            elif word == "group":
                at.groups.append(Group(parent=at))
                at = at.groups[-1]
            elif word == "endgroup":
                if at.parent is None:
                    raise ConfigError("endgroup without group")
                at = at.parent
            else:
                (at.paths if line[-1] in "/\\" else at.files).append(normal_path(base, line))
        except ValueError as e:
            raise ConfigError(f"{name}({n}): {e}") from e
    if at is not root:
        raise ConfigError(f"{name}: group without endgroup")
    return root


def home() -> str:
    """Folder of project files: ``TESSERA_HOME``, else ``.tessera`` in the home folder."""
    return os.environ.get("TESSERA_HOME") or str(Path(os.environ.get("HOME") or Path.home()) / ".tessera")


def projects(spec: str, top: str | None = None) -> list[tuple[str, str]]:
    """(name, project file) of a comma list: ``*`` or ``%`` is all, ``name/`` those below, else a name or a path. Sorted within an item."""
    top_ = Path(top or home())
    every = sorted((p.relative_to(top_).with_suffix("").as_posix(), str(p)) for p in top_.rglob("*.cfg")) if top_.is_dir() else []
    out: list[tuple[str, str]] = []
    for item in spec.split(","):
        if item in ("*", "%"):
            out += every
        elif item.endswith("/"):
            out += [p for p in every if p[0].startswith(item)]
        elif item:
            out.append((item, item) if item.endswith(".cfg") else (item, str(top_ / f"{item}.cfg")))
    return out


def new_config(file: str, path: str) -> None:
    """Write a default project file; one that is there already is left alone and is an error."""
    where = Path(file)
    if where.exists():
        raise ConfigError(f"project {file} already exists")
    rows = [f"path {normal_path(os.getcwd(), path)}", ""]
    for language, endings in LANGUAGES.items():
        rows += [f"# {language}", f"include \\.({endings})$"]
    where.parent.mkdir(parents=True, exist_ok=True)
    where.write_text("\n".join([*rows, "# exclude ^folder to leave out/", "", ""]))
