"""Guards of a build: what its code is, and what may replace its output."""

from __future__ import annotations

import hashlib
import io
import tokenize
from collections.abc import Iterable, Mapping
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

_IDLE = (tokenize.COMMENT, tokenize.NL, tokenize.ENCODING)
_SHAPE = (tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE)


def code_digest(sources: Mapping[str, str] | Iterable[str], libraries: Iterable[str] = ()) -> str:
    """A digest of Python code by its tokens, with the versions of libraries: comments, blank lines and the width of white space
    do not count, anything else does, the files' names too.

    sources: files by path, or texts by name.
    """
    texts = sources if isinstance(sources, Mapping) else {p: Path(p).read_text() for p in sources}
    out = hashlib.sha256()
    for name in sorted(texts):
        out.update(f"{name}\0".encode())
        for token in tokenize.generate_tokens(io.StringIO(texts[name]).readline):
            if token.type not in _IDLE:
                word = "" if token.type in _SHAPE else token.string
                out.update(f"{token.type}:{len(word)}:{word}".encode())
    for library in sorted(libraries):
        try:
            found = version(library)
        except PackageNotFoundError:
            found = "none"
        out.update(f"\0{library}={found}".encode())
    return out.hexdigest()


def check_output(target: str, full: str, groups: Iterable[str], every: Iterable[str]) -> None:
    """Refuse a build of some groups alone that would replace the output of all of them."""
    missing = sorted(set(every) - set(groups))
    same = target.removeprefix("file:").rstrip("/") == full.removeprefix("file:").rstrip("/")
    if missing and same:
        raise ValueError(f"a build without {', '.join(missing)} may not replace {full}")


def check_inputs(wanted: Iterable[str], found: Iterable[str]) -> None:
    """Fail before anything is written where an input is missing."""
    missing = sorted(set(wanted) - set(found))
    if missing:
        raise ValueError(f"missing inputs: {', '.join(missing)}")
