"""Table configurations and text templates, as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    """One cleaned cell."""
    column: str


@dataclass(frozen=True)
class Joined:
    """Several cells joined by ``sep``, those without a value left out."""
    columns: tuple[str, ...]
    sep: str = " · "


@dataclass(frozen=True)
class Name:
    """Name parts joined by a blank; only empty parts are left out."""
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Flag:
    """Yes when the cell holds a value other than zero, empty or false."""
    column: str
    yes: str = "Yes"
    no: str = "No"


@dataclass(frozen=True)
class Code:
    """Word for a code, ``otherwise`` for every other code and for NULL."""
    column: str
    words: dict[str, str] = field(hash=False)
    otherwise: str = ""


Slot = Field | Joined | Name | Flag | Code


@dataclass(frozen=True)
class Template:
    """A text with ``{slot}`` marks. A mark without an entry in ``slots`` is a column.

    ``attachment`` names a column with the text of an attached file; when it
    has a text, its first ``attachment_chars`` characters follow the rendered row.
    """
    text: str
    slots: dict[str, Slot] = field(default_factory=dict, hash=False)
    attachment: str | None = None
    attachment_chars: int = 5000


@dataclass(frozen=True)
class TableConfig:
    """How the rows of one table become documents."""
    db: str
    table: str
    text_columns: tuple[str, ...] = ()
    metadata_columns: tuple[str, ...] = ()
    pk_column: str | None = None
    label: str = ""
    description: str = ""
    date_column: str | None = None
    file_columns: tuple[tuple[str, str], ...] = ()
    template: Template | None = field(default=None, hash=False)

    @property
    def key(self) -> str:
        return f"{self.db}.{self.table}"
