"""Landed feed pages for the tests, made from short rows."""

from __future__ import annotations

import json
from pathlib import Path

SITE = "https://news.example"


def member(title, at=None, when=None, by=None, **more):
    """``at`` is a path, or an address if it has a scheme; ``by`` is (first name, last name)."""
    out = {"title": title, **more}
    if at is not None:
        out["link" if "://" in at else "path"] = at
    if when is not None:
        out["published"] = when
    if by is not None:
        out["author"] = dict(zip(("firstname", "lastname"), by))
    return out


# The window of the tests ends on 12 November 2025.
PAGES = [
    {
        "totalItems": 75,
        "page": 1,
        "member": [
            member("Rejected: address only", "/news/undated"),
            member("Rejected: time of day only", "/news/clock", "07:45"),
            member("Harbour", "/news/harbour", "2025-11-11T23:10:00-03:00", ("Zoe", None), category={"title": "Sport"}),
            member(" \t", "/news/untitled", "2025-11-11T05:00:00Z"),
            member("Rejected: nowhere", None, "2025-11-11T05:00:00Z", ("A", "B")),
            member("Bridge\n", f"{SITE}/news/bridge?x=1", "2025-11-10 17:30:00", (" Uma ", "Kot "), category={"title": ""}),
        ],
    },
    {
        "totalItems": 75,
        "page": 2,
        "member": [
            member("Harbour again", f"{SITE}/news/harbour", "2025-11-08T06:00:00+00:00", category=None),
            member("Long ago", "/news/long-ago", "2025-09-30T08:00:00Z"),
            member("Late entry", "/news/late-entry", "2025-11-07T20:20:20.5Z", category={"title": "Kultura"}),
        ],
    },
    {"totalItems": 75, "page": 3, "member": []},
    {"totalItems": 75, "page": 4, "member": [member("Behind the gap", "/news/behind", "2025-11-09T11:11:00Z")]},
]


def write_pages(folder: str, name: str, pages: list[dict]) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    lines = "\n".join(json.dumps(page) for page in pages)
    (Path(folder) / f"{name}.json").write_text(lines)
