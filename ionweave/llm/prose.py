"""The prose of commit histories: message sentences and comment sentences, without headers, trailers, code and
automatic messages."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

_COMMIT = re.compile(r"commit [0-9a-f]{7,64}\s*\Z")
#: Messages that tools write: merges, version bumps, releases, backports, lockfile and generated-file updates.
AUTOMATIC = re.compile(
    r"merge(?:d)? (?:branch|branches|pull request|remote-tracking|tag|commit|request)\b"
    r"|bump \S+ (?:from|to) "
    r"|(?:chore|build|ci)(?:\([^)]*\))?!?: (?:release\b|bump\b|v?\d+\.\d+)"
    r"|(?:chore\(release\)|release)\s*:?\s*v?\d"
    r"|(?:automatic(?:ally)? )?backport(?:ed)? (?:of|from|#)"
    r"|(?:re)?(?:generate|update|sync|refresh)d? (?:the )?(?:lock ?files?|generated)\b"
    r"|v?\d+\.\d+\.\d+\s*\Z",
    re.I,
)
_TRAILER = re.compile(r"(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)+|Refs?|Fixes|Closes|Resolves|See|Cc|Bug|Issue|Ticket)\s*:\s")
_COMMENT = re.compile(r"[+\- ]\s*(?:#+|//+!?|/\*+|\*|;+|%+)\s+(\S.*)\Z")
_MARK = re.compile(r"\A(?:>\s*)*(?:\[#?\w+\]\s+|\w+(?:\([^)]*\))?!?:\s+(?=\S))?")
_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, *range(0x202A, 0x202F), *range(0x2066, 0x206A)])
_LETTERS = re.compile(r"[^\W\d_]{2}")


def lines_of_prose(text: str | None) -> Iterator[str]:
    """Prose lines in order, without marks of quotation, comment or commit convention."""
    if not text:
        return
    body = True  # before the first commit line an indented text counts as a message
    for line in text.split("\n"):
        c = line[:1]
        if c == "c" and _COMMIT.match(line):
            body = True
        elif c == "d" and line.startswith("diff --git "):
            body = False
        elif body:
            if line.startswith("    ") or (c == "\t"):
                s = line.strip()
                if s and not AUTOMATIC.match(s) and not _TRAILER.match(s):
                    yield s
        elif c in "+- " and c:
            if m := _COMMENT.match(line.rstrip()):
                yield m[1].removesuffix("*/").strip()


def sentences(text: str | None) -> Iterator[str]:
    """Prose sentences, compatibility characters folded and invisible ones dropped; only those with some word in them."""
    for line in lines_of_prose(text):
        s = unicodedata.normalize("NFKC", line.translate(_INVISIBLE))
        s = s[_MARK.match(s).end() :]
        for part in _END.split(s):
            if _LETTERS.search(part):
                yield part.strip()
