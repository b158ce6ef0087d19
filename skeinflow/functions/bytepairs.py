"""Byte-pair encoding of texts of any length with the tiktoken library and a local rank file's bytes.

The library's pattern engine matches with a stack that grows with a run of white space, and fails on very long ones.
Under the one pattern whose matches are known here, texts are cut where a match always ends and long runs of white space
are handed over as the matches that they are. Under any other pattern a text goes to the library whole; where that fails,
its matches are found by the ``regex`` module and encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import regex

#: Characters handed to the library at once; longer texts are cut at the next safe boundary.
SPAN = 50_000
#: Fixed value: the splitting pattern for which ``SAFE`` and ``WHITE_RUN`` hold.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between these two characters a match always ends: no alternative runs from a non-space into a space, or from a letter
#: or digit into another class. Letters and digits are ASCII ones, since Unicode tables differ by library.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])")
#: Runs of white space that the library's pattern engine isn't asked to match.
WHITE_RUN = regex.compile(r"\s{1000,}")

_encoders: dict[tuple[str, str], object] = {}


def encoder(ranks_file: bytes, pattern: str):
    """The encoding of a rank file's bytes, made once in each Python worker."""
    import tiktoken

    key = (hashlib.sha256(ranks_file).hexdigest(), pattern)
    if key not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks_file.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def spans(text: str, span: int = SPAN) -> Iterator[str]:
    """Cuts a text at safe boundaries; a longer stretch without one stays whole."""
    at = 0
    while len(text) - at > span:
        cut = SAFE.search(text, at + span)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _encode_span(enc, text: str) -> list[int]:
    """Ids of a text with white-space runs of any length: before a non-space such a run is one match of all but its last
    character, at the text's end one of all of it, so these matches are handed to the library by themselves."""
    ids: list[int] = []
    at = 0
    for run in WHITE_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += enc.encode_ordinary(text[at : run.start()])
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    return ids + enc.encode_ordinary(text[at:])


def _encode_whole(enc, text: str) -> list[int]:
    try:
        return enc.encode_ordinary(text)
    except BaseException as error:  # noqa: BLE001  what the library raises here is no Exception
        if type(error).__name__ != "PanicException":
            raise
    return [token for m in regex.finditer(enc._pat_str, text) for token in enc._encode_single_piece(m.group())]


def encode(enc, text: str, span: int = SPAN) -> list[int]:
    """Ids of a text without special tokens."""
    if enc._pat_str != KNOWN:
        return _encode_whole(enc, text)
    if len(text) <= span:
        return enc.encode_ordinary(text)
    return [token for part in spans(text, span) for token in _encode_span(enc, part)]
