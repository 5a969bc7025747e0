"""Tables of settings: what each key must be, declared once and checked in one place.

A file is read whole and all its faults are reported together, each with the path
of its key, so that one run of a command shows everything that has to be mended.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

_NEEDED = object()


@dataclass(frozen=True)
class Key:
    """A setting: what it must be, in words and as a test, and its value where it is left out."""

    wants: str
    good: Callable[[object], bool]
    otherwise: object = _NEEDED

    def or_else(self, otherwise: object) -> Key:
        return Key(self.wants, self.good, otherwise)


def _is(*kinds: type) -> Callable[[object], bool]:
    """Truth values are numbers to Python but not here."""
    return lambda v: isinstance(v, kinds) and (bool in kinds or not isinstance(v, bool))


TEXT = Key("a text", _is(str))
NAME = Key("a text that is not empty", lambda v: isinstance(v, str) and v != "")
PHRASE = Key("a text that is not blank", lambda v: isinstance(v, str) and v.strip() != "")
FLAG = Key("true or false", _is(bool))
WHOLE = Key("a whole number", _is(int))
COUNT = Key("a whole number from 0", lambda v: _is(int)(v) and v >= 0)
TEXTS = Key("a list of texts", lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v))
NAMES = Key("a list of texts that are not empty", lambda v: isinstance(v, list) and all(isinstance(x, str) and x for x in v))
TABLE = Key("a table", _is(dict))
ROWS = Key("a list that is not empty", lambda v: isinstance(v, list) and len(v) > 0)


class Faults:
    """Gathers what is wrong with a file."""

    def __init__(self, file: object) -> None:
        self.file, self.found = file, []

    def add(self, where: str, what: str) -> None:
        self.found.append(f"{where}: {what}")

    def stop(self, error: type[Exception]) -> None:
        if self.found:
            raise error(f"{self.file}: " + "; ".join(self.found))

    def read(self, table: object, keys: dict[str, Key], where: str = "") -> dict:
        """The values of ``keys``; those at fault are None. Other keys are not looked at."""
        if not isinstance(table, dict):
            self.add(where, f"should be {TABLE.wants}, not {table!r}")
            return dict.fromkeys(keys)
        out = {}
        for name, key in keys.items():
            at, value = f"{where}.{name}".lstrip("."), table.get(name, key.otherwise)
            ok = name not in table and value is not _NEEDED or name in table and key.good(value)
            if not ok:
                self.add(at, "is needed" if name not in table else f"should be {key.wants}, not {value!r}")
            out[name] = value if ok else None
        return out


def read_toml(file: str | Path, error: type[Exception]) -> dict:
    """A TOML file as a table; whatever keeps it from being one raises ``error``. A byte order mark is no fault."""
    try:
        return tomllib.loads(Path(file).read_bytes().decode("utf-8-sig"))
    except (OSError, ValueError) as e:
        what = {FileNotFoundError: "no such file", UnicodeDecodeError: "not UTF-8", tomllib.TOMLDecodeError: "not TOML"}.get(type(e), "can't be read")
        raise error(f"{file}: {what} ({e})") from e
